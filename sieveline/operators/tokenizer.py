"""Pair-merge encoding by a tokenizer file's own tables: byte-level and metaspace files, added tokens, parity with published ids."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The splitting pattern of byte-level files, and the mark of a word's start in metaspace files.
_WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
MARK = "▁"


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged(parts: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """parts after all merges, the one of least rank first and the leftmost of those; n log n in the number of parts.

    Parts are a linked list; a queue holds the pairs that can merge, and pairs whose parts have changed since are skipped.
    """
    n = len(parts)
    parts, after, before = [*parts], [*range(1, n + 1)], [*range(-1, n - 1)]
    queue = [(rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (pair := (parts[k], parts[after[k]])) in rank:
                heapq.heappush(queue, (rank[pair], k, *pair))
    return [p for p in parts if p]


def nodes_of(tree) -> Iterator[dict]:
    """All objects of a nested JSON value that have a type."""
    if isinstance(tree, dict):
        if "type" in tree:
            yield tree
        tree = list(tree.values())
    if isinstance(tree, list):
        for x in tree:
            yield from nodes_of(x)


class PairMerger:
    """Encodes texts with a file's vocabulary and ranked merges; what a word gave is remembered, up to a limit.

    Files with a byte-level step take NFC texts by the splitting pattern, as bytes; others replace by their own rules and take
    words from mark to mark, with runs of line ends as words of their own and, if the file says so, bytes for unknown parts.
    Added tokens are cut out first, longest first: those of raw texts before those of normalised ones.
    """

    def __init__(self, path_or_file: str | dict, limit: int = 200_000):
        if isinstance(path_or_file, str):
            with open(path_or_file, encoding="utf-8") as f:
                path_or_file = json.load(f)
        file, model = path_or_file, path_or_file["model"]
        self.vocab, self.limit, self.known = model["vocab"], limit, {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.chars = byte_characters()
        steps = [x for part in ("normalizer", "pre_tokenizer", "decoder") for x in nodes_of(file.get(part))]
        self.byte_level = any(x["type"] == "ByteLevel" for x in steps)
        self.replaces = [(x["pattern"]["String"], x["content"]) for x in nodes_of(file.get("normalizer")) if x["type"] == "Replace" and "String" in x["pattern"]] or [(" ", MARK)]
        self.byte_fallback = bool(model.get("byte_fallback"))
        self.unknown = self.vocab.get(model.get("unk_token") or "[UNK]", self.vocab.get("<unk>"))
        self.phases = []
        for normalised in (False, True):
            added = {t["content"]: t for t in file.get("added_tokens", []) if t["content"] and bool(t.get("normalized")) == normalised}
            if added:
                self.phases.append((normalised, regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))), added))

    def word(self, word: str) -> list[int]:
        if self.byte_level:
            found = (self.vocab.get(p, self.unknown) for p in merged([self.chars[b] for b in word.encode("utf-8", "surrogatepass")], self.rank))
            return [i for i in found if i is not None]
        out: list[int] = []
        for part in merged([*word], self.rank):
            own = self.vocab.get(part)
            spelled = [self.vocab.get(f"<0x{b:02X}>") for b in part.encode("utf-8", "surrogatepass")] if own is None and self.byte_fallback else [None]
            out += [own] if own is not None else spelled if None not in spelled else [] if self.unknown is None else [self.unknown]
        return out

    def words(self, text: str) -> list[str]:
        if self.byte_level:
            return _WORDS.findall(unicodedata.normalize("NFC", text))
        for a, b in self.replaces:
            text = text.replace(a, b)
        out = []
        for run in regex.findall(r"\n+|[^\n]+", text):
            if run[0] == "\n":
                out.append(run)
            else:
                out += [MARK + w for w in run.removeprefix(MARK).split(MARK)]
        return out

    def pieces(self, text: str) -> list[str | int]:
        """The text cut at added tokens, which are their ids."""
        out: list[str | int] = [text]
        for normalised, pattern, added in self.phases:
            cut: list[str | int] = []
            for p in out:
                if isinstance(p, int):
                    cut.append(p)
                    continue
                p, last = unicodedata.normalize("NFC", p) if normalised and self.byte_level else p, 0
                for m in pattern.finditer(p):
                    token, start = added[m[0]], m.start()
                    if start < last:
                        continue
                    head = p[last:start].rstrip() if token.get("lstrip") else p[last:start]
                    cut += [head] if head else []
                    cut.append(token["id"])
                    last = m.end()
                    if token.get("rstrip"):
                        last += len(p[last:]) - len(p[last:].lstrip())
                cut += [p[last:]] if p[last:] else []
            out = cut
        return out

    def encode(self, text: str | None) -> list[int]:
        if len(self.known) > self.limit:
            self.known = {}
        ids: list[int] = []
        for piece in self.pieces(text or ""):
            if isinstance(piece, int):
                ids.append(piece)
                continue
            for w in self.words(piece):
                got = self.known.get(w)
                if got is None:
                    got = self.known[w] = self.word(w)
                ids += got
        return ids


@functools.lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def encode(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, ids of every whole text; a null text has none."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[key], pa.array([merger(path).encode(t) for t in b[text].to_pylist()], pa.list_(pa.int32()))], names=[key, "ids"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def parity(vectors: DataFrame, got: DataFrame, key: str, tolerance: Column | float) -> DataFrame:
    """One row: ids_wrong, max_delta, top1, vectors, ok, from published vectors (key, ids, logits) and what a device made of them.

    A vector that the device has not made counts as wrong ids. Logits are held against each other up to the shorter one; ok
    needs no wrong ids and no difference beyond the tolerance.
    """
    rows = vectors.join(got.select(key, F.col("ids").alias("_ids"), F.col("logits").alias("_z")), key, "left")
    n = F.least(F.size("logits"), F.size("_z"))
    a, b = F.slice("logits", F.lit(1), n), F.slice("_z", F.lit(1), n)
    both = F.col("_z").isNotNull() & (n > 0)
    rows = rows.select((~F.coalesce(F.col("ids") == F.col("_ids"), F.lit(False))).alias("wrong"), F.when(both, F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))).alias("delta"), F.when(both, F.array_position(a, F.array_max(a)) == F.array_position(b, F.array_max(b))).alias("same"))
    out = rows.agg(F.count_if("wrong").alias("ids_wrong"), F.coalesce(F.max("delta"), F.lit(0.0)).alias("max_delta"), F.avg(F.col("same").cast("double")).alias("top1"), F.count(F.lit(1)).alias("vectors"))
    limit = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return out.withColumn("ok", (F.col("ids_wrong") == 0) & (F.col("max_delta") <= limit))
