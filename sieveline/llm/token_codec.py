"""Token ids as canonical length-limited Huffman codes, in Parquet segments with bit-offset checkpoints.

File format: a Parquet dataset of segments, each some documents in a row of ascending doc_id order. A segment holds its place
(part, seq), the ids and token counts of its documents, and `payload`: the codes of all its ids, most significant bit first.
Codes are canonical, so that the dataset `codebook` (token id, code length of at most MAX_BITS) fixes them. `checkpoints` has
the bit offset of every BLOCK-th token: blocks are decoded independently of each other, all of a segment in step.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ChunkTable, delete_folder, ranges, scratch_dir, spans, sums

#: Longest code in bits; also the width of the decoding table.
MAX_BITS = 18
#: Tokens in an independent block.
BLOCK = 256
#: Tokens that one step of the encoding takes, whole blocks.
STEP = 64 * BLOCK
#: Tokens after which a segment ends (a longer document is a segment of its own).
SEGMENT_TOKENS = 500_000
#: Bytes of texts that are encoded at once (a longer text by itself).
STEP_BYTES = 1_500_000
#: Words sent to the tokenizer as one text.
JOINED = 40
#: Id appended to every document.
END_ID = 1

_SEGMENT = "part int, seq bigint, doc_ids array<bigint>, n_tokens array<bigint>, payload binary, checkpoints array<bigint>, n_ids bigint"


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal prefix-code lengths of at most max_bits by the package-merge algorithm; ties by id."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) > 1 << max_bits:
        raise ValueError("too many symbols for the code length")
    if len(symbols) <= 1:
        return dict.fromkeys(symbols, 1)
    weights = np.array([counts[s] for s in symbols], float)
    # Each level's list is a sorted merge of the leaves and the pairs of the level below; only the numbers of leaves matter.
    level, kinds = weights, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        kinds.append(order < len(weights))
        level = both[order]
    lengths, taken = np.zeros(len(symbols), int), 2 * (len(symbols) - 1)
    for leaf in reversed(kinds):
        n_leaves = int(leaf[:taken].sum())
        lengths[:n_leaves] += 1
        taken = 2 * (taken - n_leaves)
    lengths[:taken] += 1
    return {s: int(n) for s, n in zip(symbols, lengths, strict=True)}


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, lengths: dict[int, int]):
        symbols, bits = np.array([*lengths], np.int64), np.array([*lengths.values()], np.int64)
        order = np.lexsort((symbols, bits))
        symbols, bits = symbols[order], bits[order]
        self.width = max(lengths.values(), default=1)
        spans = 1 << (self.width - bits)  # of the decoding table's entries that begin with each code
        first = np.cumsum(spans) - spans
        size = max(lengths, default=0) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[symbols], self.bits[symbols] = first >> (self.width - bits), bits
        self.table = np.ones(1 << self.width, np.uint32)  # the symbol, times 32, and the length of the code that these bits begin with
        self.table[: spans.sum()] = np.repeat(symbols * 32 + bits, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of all codes, zero-padded by 8 bytes at least, and the bit offset of each block's first token."""
        total = int(self.bits[ids].sum()) if len(ids) else 0
        words, offsets, bit = np.zeros(total // 64 + 3, np.uint64), [np.empty(0, np.int64)], 0
        for first in range(0, len(ids), STEP):
            part = ids[first : first + STEP]
            bits, code = self.bits[part], self.code[part]
            ends = np.cumsum(bits) + bit
            starts = ends - bits
            at, free = starts >> 6, 64 - (starts & 63) - bits  # a negative number of free bits goes on in the next word
            over = np.flatnonzero(free < 0)
            high = code << np.maximum(free, 0).astype(np.uint64)
            high[over] = code[over] >> (-free[over]).astype(np.uint64)
            self._gather(words, at, high)
            self._gather(words, at[over] + 1, code[over] << (64 + free[over]).astype(np.uint64))
            offsets.append(starts[::BLOCK])
            bit = int(ends[-1])
        return words.byteswap().tobytes()[: (total + 7) // 8 + 8], np.concatenate(offsets)

    @staticmethod
    def _gather(words: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """words[at] |= values for ascending positions with repeats; the bits of equal positions are disjoint."""
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            words[at[first]] |= np.bitwise_or.reduceat(values, first)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """All ids of a segment; the k-th token of every block is looked up at once."""
        data = np.frombuffer(payload, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte on
        found = np.zeros((block, len(checkpoints)), np.uint32)
        position, last = checkpoints.astype(np.int64), len(window) - 1
        shift, mask = np.arange(32 - self.width, 24 - self.width, -1).astype(np.uint32), np.uint32((1 << self.width) - 1)
        lanes = len(checkpoints)
        short = n - block * (lanes - 1) if lanes else 0
        for k in range(block if lanes else 0):
            if k == short:  # the last block is shorter than the others
                position, lanes = position[:-1], lanes - 1
            index = (window[np.minimum(position >> 3, last)] >> shift[position & 7]) & mask
            entry = self.table[index]
            found[k, :lanes] = entry
            position = position + (entry & 31)
        return (found.T.reshape(-1)[:n]) >> np.uint32(5)


#: Texts of characters below U+0250 whose NFC form is themselves and whose lower case does not depend on neighbours.
_PLAIN = re.compile("[\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u024f]*")
#: The same for the columnar engine, as what such a text does not hold: other characters, or what may begin a special token.
_NOT_PLAIN = r"[^\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"


class Encoder:
    """Whole texts to ids with a tokenizers file; the ids of pieces are remembered, up to a limit.

    The tokenizer drops white space and encodes each match of its splitting pattern by itself, so a text's ids are those of
    its chunks between white space in a row. Each distinct chunk of a call is worked on once: chunks of plain characters are
    lower-cased and cut by the file's own pattern into pieces; others (marks, scripts whose forms depend on neighbours, special
    tokens) go to the library as they are. New pieces go to the library many at a time.
    """

    def __init__(self, path: str, end_id: int = END_ID, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        file = json.loads(self.tokenizer.to_str())
        self.pattern = _split_pattern(file)
        self.last = _word_ends(file) if self.pattern is not None else None
        self.table = ChunkTable(self._ids, np.int32, limit)

    def _ids(self, pieces: list[str]) -> list:
        """The ids of each piece; runs of plain words go to the library as one text, whose ids are cut at the ends of words."""
        out: list = [[]] * len(pieces)
        words = [i for i, p in enumerate(pieces) if self.last is not None and p.isalpha() and _PLAIN.fullmatch(p)]
        alone = sorted({i for i, p in enumerate(pieces) if p != "\n"}.difference(words))
        for at in range(0, len(words), 4000):
            runs = [words[i : i + JOINED] for i in range(at, min(at + 4000, len(words)), JOINED)]
            for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in run]) for run in runs], add_special_tokens=False), strict=True):
                ids = found.ids
                ends = np.flatnonzero(self.last[ids]).tolist()
                if len(ends) != len(run) or ends[-1] != len(ids) - 1:
                    alone += run
                    continue
                first = 0
                for i, end in zip(run, ends, strict=True):
                    out[i] = ids[first : end + 1]
                    first = end + 1
        for at in range(0, len(alone), 4000):
            part = alone[at : at + 4000]
            for i, found in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks, where those of each begin and how many they are."""
        if self.pattern is None:
            plain = np.zeros(len(chunks), bool)
        else:
            plain = ~pc.match_substring_regex(chunks, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        first, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        pieces: list = []
        if len(first):  # each chunk's pieces, then a line end, which has no ids
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), chunks.take(pa.array(first))), "\n")[0].as_py()
            pieces = self.pattern.findall(lines.lower() + "\n")
        found = self.table.number(itertools.chain(pieces, chunks.take(pa.array(others)).to_pylist()), len(pieces) + len(others))
        flat, each = self.table.gather(found)
        sizes = np.ones(len(others), np.int64)
        if len(first):
            breaks = np.flatnonzero(found[: len(pieces)] == found[len(pieces) - 1])
            sizes = np.concatenate([np.diff(breaks, prepend=-1), sizes])
        counts = sums(each, sizes)
        starts, place = np.cumsum(counts) - counts, np.empty(len(chunks), np.int64)
        place[np.concatenate([first, others])] = np.arange(len(chunks))
        return flat, starts[place], counts[place]

    def encode(self, texts: list[str | None] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, the end id after each, and the number of ids of each."""
        cut = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        found = cut.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)
        flat, starts, counts = self._chunks(found.dictionary)
        end = len(found.dictionary)  # a further chunk, which ends each text
        chunks = np.insert(found.indices.to_numpy().astype(np.int64), np.cumsum(sizes), end)
        flat, starts, counts = np.append(flat, np.int32(self.end_id)), np.append(starts, len(flat)), np.append(counts, 1)
        each = counts[chunks]
        return flat[spans(starts[chunks], each)], sums(each, sizes + 1)


def _split_pattern(file: dict) -> re.Pattern | None:
    """The splitting pattern, for plain characters, or a line end; of a file that lower-cases, keeps matches only and then takes their bytes; else None."""
    kinds = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    split = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"] or split[1]["use_regex"] or split[1]["add_prefix_space"]:
        return None
    if split[0]["behavior"] != "Removed" or not split[0]["invert"]:
        return None
    chars = [chr(c) for c in range(0x20, 0x250)]
    pattern = split[0]["pattern"]["Regex"]
    for name, kind in (("\\p{L}", "L"), ("\\p{N}", "N")):
        pattern = pattern.replace(name, "".join(c for c in chars if unicodedata.category(c)[0] == kind))
    return re.compile(pattern + "|\n")


def _word_ends(file: dict) -> np.ndarray | None:
    """Whether each id ends a word, for files whose tokens say so by a suffix that stands nowhere else; else None."""
    model = file["model"]
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("unk_token") or model.get("dropout") or any(suffix in t[:-1] and t.index(suffix) + len(suffix) < len(t) for t in model["vocab"]):
        return None
    out = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in file["added_tokens"])]) + 1, bool)
    out[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return out


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


_RAW = "part int, seq bigint, doc_ids array<bigint>, n_tokens array<bigint>, low binary, high binary, counted binary"
_RAW_TYPES = {"part": pa.int32(), "seq": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "low": pa.binary(), "high": pa.binary(), "counted": pa.binary()}
_SEGMENT_TYPES = {"part": pa.int32(), "seq": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "payload": pa.binary(), "checkpoints": pa.list_(pa.int64()), "n_ids": pa.int64()}


def _row(types: dict[str, pa.DataType], **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values[n]], t) for n, t in types.items()], names=[*types])


def _planes(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Low bytes, and the other 24 bits as shorts or longs: the planes compress better than whole numbers."""
    ids = ids.astype(np.uint32)
    high = ids >> 8
    return ids.astype(np.uint8).tobytes(), high.astype(np.uint8).tobytes() if not len(high) or high.max() < 256 else high.astype("<u4").tobytes()


def _from_planes(low: bytes, high: bytes) -> np.ndarray:
    bottom = np.frombuffer(low, np.uint8)
    top = np.frombuffer(high, np.uint8 if len(high) == len(low) else "<u4")
    return (top.astype(np.int64) << 8) | bottom


def _tokenise(ordered: DataFrame, tokenizer: str, segment_tokens: int) -> DataFrame:
    """Runs of documents with their ids, in the order of the partitions and their rows; `counted` in a task's last one has all its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), shared_encoder(tokenizer), 0
        names: list = []
        sizes: list = []
        held: list = []
        total = np.zeros(0, np.int64)

        def segment(last: bool = False):
            nonlocal seq, total
            ids = np.concatenate(held)
            counts = np.bincount(ids, minlength=len(total))
            counts[: len(total)] += total
            total = counts
            low, high = _planes(ids)
            row = _row(_RAW_TYPES, part=part, seq=seq, doc_ids=list(names), n_tokens=list(sizes), low=low, high=high, counted=total.astype("<i8").tobytes() if last else None)
            seq += 1
            for x in (names, sizes, held):
                x.clear()
            return row

        for b in batches:
            texts, ids = b["text"], b["doc_id"].to_pylist()
            for i, j in ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), STEP_BYTES):
                if sum(map(len, held)) >= segment_tokens:
                    yield segment()
                found, n = encoder.encode(texts.slice(i, j - i))
                names += ids[i:j]
                sizes += n.tolist()
                held.append(found)
        if held:
            yield segment(last=True)

    return ordered.mapInArrow(run, _RAW)


def _count(raw: DataFrame) -> dict[int, int]:
    """Occurrences of each id over all documents (at most one entry per id of the vocabulary), from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b["counted"]:
                found = np.frombuffer(x.as_py(), "<i8")
                grown = np.zeros(max(len(total), len(found)), np.int64)
                grown[: len(total)] = total
                grown[: len(found)] += found
                total = grown
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = raw.select("counted").where("counted is not null").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes docs (doc_id, text) into the two datasets `codebook` and `segments` under path, in ascending doc_id order.

    Texts are tokenised once, into a dataset `raw` under path that is counted, coded and then deleted. Null and empty texts are
    documents of the end id alone. A null doc_id comes first; rows with equal ids are neighbours in the order of their texts.
    An empty table writes no segments. Other columns are not read. Counts cover all texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    _tokenise(rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text"), tokenizer, segment_tokens).write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(_RAW).parquet(f"{path}/raw")
    lengths = code_lengths(_count(raw))
    spark.createDataFrame(sorted(lengths.items()) or [], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for b in batches:
            for k in range(b.num_rows):
                ids = _from_planes(b["low"][k].as_py(), b["high"][k].as_py())
                payload, checkpoints = book.encode(ids)
                yield _row(_SEGMENT_TYPES, **{n: b[n][k].as_py() for n in ("part", "seq", "doc_ids", "n_tokens")}, payload=payload, checkpoints=checkpoints.tolist(), n_ids=len(ids))

    raw.drop("counted").mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")
    delete_folder(spark, f"{path}/raw")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document in file order: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if asked for.

    Segment starts come from the counts in the segments' rows: summed within each part, then over the parts' totals.
    """
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before_parts = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    heads = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = heads.join(before_parts, "part").select("part", "seq", (F.col("before") + F.col("before_part")).alias("first"))
    shared = spark.sparkContext.broadcast(lengths)
    schema = "part int, seq bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b[n][k] for n in b.schema.names}
                sizes = np.array(row["n_tokens"].as_py(), np.int64)
                ids = book.decode(row["payload"].as_py(), np.array(row["checkpoints"].as_py(), np.int64), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                columns = [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["seq"].as_py()] * n, pa.int64()), pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    decoded = segments.select("part", "seq", "doc_ids", "n_tokens", "payload", "checkpoints").mapInArrow(run, schema)
    return decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs to a new file set in the shared folder and returns what read_tokens finds there."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
