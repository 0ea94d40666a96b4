"""Helpers shared by the training-data operators: tables, shared scratch space, word and shingle hashes."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle.
SHINGLE = 5
#: Characters of text that one step of a worker's loop takes at a time (a single longer text is a step of its own).
STEP_CHARS = 2_000_000

_local_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Without it, a temporary folder in local mode, else an error."""
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="sieveline-")
    return _local_scratch


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, path)


def whole_rows(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, so that columns added beside it clash with none of theirs; select(f"{name}.*") gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias(name)


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def steps(texts: list[str | None], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """(first, end) row ranges of at most `chars` characters, each of one row at least."""
    return ranges([len(t) if t else 0 for t in texts], chars)


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) row ranges whose sizes add up to `most` at most, each of one row at least."""
    first = size = 0
    for i, n in enumerate(sizes):
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype, width: tuple = ()):
        self.all, self.n = np.empty((4096, *width), dtype), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.all.dtype)
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.empty((len(self.all) + len(values), *self.all.shape[1:]), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.all[: self.n]


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class ChunkTable:
    """Maps each white-space chunk of a text to a list of numbers, made once and remembered until `limit` chunks are known.

    `make(chunks)` gives the lists of new chunks.
    """

    def __init__(self, make, dtype=np.uint64, limit: int = 400_000):
        self.make, self.dtype, self.limit = make, dtype, limit
        self.reset()

    def reset(self) -> None:
        self.rows = _Numbered()
        self.flat, self.start, self.count = Growing(self.dtype), Growing(np.int64), Growing(np.int64)

    def number(self, chunks: Iterable, n: int) -> np.ndarray:
        """The row numbers of n chunks; numbers of earlier calls no longer hold."""
        if len(self.rows) > self.limit:
            self.reset()
        known = len(self.rows)
        ids = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, n)
        if len(self.rows) > known:
            made = self.make(list(itertools.islice(reversed(self.rows), len(self.rows) - known))[::-1])
            counts = np.fromiter(map(len, made), np.int64, len(made))
            self.start.extend(self.flat.n + np.cumsum(counts) - counts)
            self.count.extend(counts)
            self.flat.extend(np.fromiter(itertools.chain.from_iterable(made), self.dtype, int(counts.sum())))
        return ids

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows one after another, and how many each row has."""
        each = self.count.view()[ids]
        return self.flat.view()[spans(self.start.view()[ids], each)], each

    def values(self, docs: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all documents (lists of chunks) one after another, and how many each document has."""
        docs = list(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        flat, each = self.gather(self.number(itertools.chain.from_iterable(docs), int(sizes.sum())))
        return flat, sums(each, sizes)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions from each start on, as many as its count, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(sizes)])])


def word_hashes(words: list) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in words]


def gram_hashes(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie within one document, and the document's position for each."""
    total = len(words)
    if total < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    h = np.full(total - n + 1, n * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    for i in range(n):
        h = mix64(h * mult + words[i : total - n + 1 + i])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[: total - n + 1] == doc[n - 1 :]
    return h[inside], doc[: total - n + 1][inside]


def shingle_sets(words: np.ndarray, sizes: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Per document its sorted distinct n-gram hashes; with fewer than n words, one hash of the whole sequence; none without words."""
    h, doc = gram_hashes(words, sizes, n)
    bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
    ends = np.cumsum(sizes)
    out = []
    for d, size in enumerate(sizes):
        if size >= n:
            out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
        elif size:
            own = words[ends[d] - size : ends[d]]
            out.append(gram_hashes(own, np.array([size]), int(size))[0])
        else:
            out.append(np.empty(0, np.uint64))
    return out
