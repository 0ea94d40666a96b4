"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A long document and a short test item have a tiny Jaccard similarity however much of the item the document holds, so the
search asks the other way round. An item's MinHash sketch is its s shingles of smallest hash; a document that holds a share t
of the item holds each sketch shingle with probability t. Items are partitioned by the size of their shingle set (powers of
two). Each partition has an index, a sketch length and a threshold of its own, and is probed by itself: s is one more than the
shingles that the partition's largest item may lack, and a document is a candidate for an item from so many of its sketch
shingles on as any document with t * m of the m shingles must hold (by the pigeonhole principle). In partitions where s would
exceed SKETCH it is SKETCH and one shingle makes a candidate; an item is missed with probability (1 - t) ** SKETCH at most
(1e-17). Every document is read once per block of items; candidates are verified on all shingles of the whole text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, ChunkTable, gram_hashes, mix64, shingle_sets, steps, word_hashes

CONTAINMENT = 0.8
#: Largest sketch of an item.
SKETCH = 24
#: Characters of benchmark text that are sent to executors at once; larger benchmarks go in blocks of about that size.
BLOCK_CHARS = 64_000_000
_BITS = 22
_EPS = 1e-9

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PAIRS = "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint"


def _chunk_words(chunks: list[str]) -> list[list[int]]:
    return [word_hashes(_WORD.findall(c)) for c in chunks]


def _split(text: str | None) -> list[str]:
    return text.lower().split() if text else []


@dataclass
class Partition:
    """Items of one size class and word length: the sketch length, the sketch shingles a candidate must hold, and who has which."""

    sketch: int
    need: int
    keys: np.ndarray
    starts: np.ndarray
    members: np.ndarray

    def candidates(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, items) with enough sketch shingles among the hashes of those documents."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        true = self.keys[at] == hashes
        if not true.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        d, k = np.unique(np.stack([doc[true], at[true]]), axis=1)
        each = self.starts[k + 1] - self.starts[k]
        ends = np.cumsum(each)
        items = self.members[np.arange(ends[-1]) + np.repeat(self.starts[k] - ends + each, each)]
        pairs, count = np.unique(np.stack([np.repeat(d, each), items]), axis=1, return_counts=True)
        return pairs[0][count >= self.need], pairs[1][count >= self.need]


@dataclass
class Items:
    """A block of items: shingle sets, per shingle length a filter of all sketch shingles, and the partitions by (length, size class)."""

    ids: list
    sets: list[np.ndarray]
    filters: dict[int, np.ndarray]
    partitions: dict[tuple[int, int], Partition]

    def __bool__(self) -> bool:
        return bool(self.partitions)


def _lacking(m: int, containment: float) -> int:
    """Shingles of m that a document may lack and still hold the share."""
    return m - int(np.ceil(containment * m - _EPS))


def index_items(rows: list[tuple], containment: float = CONTAINMENT) -> Items:
    """Rows (item id, text) as partitions; items without words have no shingles and match nothing."""
    table = ChunkTable(_chunk_words)
    words, sizes = table.values(_split(t) for _, t in rows)
    sets = shingle_sets(words, sizes)
    classes: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, s in enumerate(sets):
        if len(s):
            classes[min(int(sizes[i]), SHINGLE), len(s).bit_length()].append(i)
    filters, partitions = {}, {}
    for (n, size), members in classes.items():
        sketch = min(SKETCH, max(_lacking(len(sets[i]), containment) for i in members) + 1)
        by_hash: dict[int, list[int]] = defaultdict(list)
        for i in members:
            for h in sets[i][np.argsort(mix64(sets[i]))[:sketch]]:
                by_hash[int(h)].append(i)
        need = max(1, min(min(sketch, len(sets[i])) - _lacking(len(sets[i]), containment) for i in members))
        keys = np.array(sorted(by_hash), np.uint64)
        lists = [by_hash[int(k)] for k in keys]
        partitions[n, size] = Partition(sketch, need, keys, np.cumsum([0, *map(len, lists)]), np.concatenate([np.array(x, np.int64) for x in lists]))
        filters.setdefault(n, np.zeros(1 << _BITS, bool))[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Items([i for i, _ in rows], sets, filters, partitions)


def matches(items: Items, words: np.ndarray, sizes: np.ndarray, containment: float = CONTAINMENT) -> list[tuple[int, int, int, int]]:
    """(document position, item position, item's shingles, those found) of all pairs that reach the containment."""
    out = []
    for n, seen in items.filters.items():
        h, doc = gram_hashes(words, sizes, n)
        maybe = np.flatnonzero(seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        found = [p.candidates(h[maybe], doc[maybe]) for (length, _), p in items.partitions.items() if length == n]
        of_doc, of_item = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        for d in np.unique(of_doc):
            own = np.sort(h[slice(*np.searchsorted(doc, [d, d + 1]))])
            for i in of_item[of_doc == d]:
                item = items.sets[i]
                place = np.minimum(np.searchsorted(own, item), len(own) - 1)
                held = int((own[place] == item).sum())
                if held >= containment * len(item) - _EPS:
                    out.append((int(d), int(i), len(item), held))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    rows = benchmark.select(F.col("item_id"), F.col("text")).where(F.col("text").isNotNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in block.collect()]


def _scan(docs: DataFrame, items: Items, containment: float, schema: str, emit) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(_chunk_words)
        for b in batches:
            texts, found = b["text"].to_pylist(), []
            for i, j in steps(texts):
                words, sizes = table.values(_split(t) for t in texts[i:j])
                found += [(i + d, *rest) for d, *rest in matches(shared.value, words, sizes, containment)]
            yield emit(b, found, shared.value)

    return docs.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs doc_id, item_id, n_shingles, n_found, containment: the document holds that share of the item's distinct shingles.

    Words are runs of letters and digits of the lower-cased text; shingles are five words, for items of one to four words the
    whole item. Null, empty and wordless texts match nothing on either side; an empty table on either side gives no pairs.
    Repeated rows give repeated pairs, a null id gives pairs with a null; other columns are not read.
    """

    def emit(b: pa.RecordBatch, found: list, items: Items) -> pa.RecordBatch:
        ids = b["doc_id"].to_pylist()
        columns = [[ids[f[0]] for f in found], [items.ids[f[1]] for f in found], [f[2] for f in found], [f[3] for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shingles", "n_found"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    out = None
    for block in _blocks(benchmark):
        part = _scan(rows, index_items(block, containment), containment, _PAIRS, emit)
        out = part if out is None else out.unionAll(part)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, all columns, that hold no item to that share.

    Null, empty and wordless texts hold none and stay, as all rows do where the benchmark is empty. Rows are judged by their
    whole text alone, so that repeated rows and rows without an id fare alike; an empty table gives no rows; columns of any
    other name pass through.
    """

    def emit(b: pa.RecordBatch, found: list, items: Items) -> pa.RecordBatch:
        clean = np.ones(b.num_rows, bool)
        clean[[f[0] for f in found]] = False
        return b.filter(pa.array(clean))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in _blocks(benchmark):
        docs = _scan(docs, index_items(block, containment), containment, schema, emit)
    return docs


#: DuckDB SQL for find_leaks over the tables documents and benchmark.
LEAKS_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bs),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*)::DOUBLE / n_shingles AS containment
FROM ds JOIN bs USING (n, s) JOIN m USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 10 * count(*) >= 8 * n_shingles
"""
