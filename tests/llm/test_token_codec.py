import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm.queries import tokenizer_path
from sieveline.llm.token_codec import BLOCK, Codebook, code_lengths, read_tokens, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain(tokenizer, rows):
    out, start = [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def huffman_cost(counts):
    import heapq

    h, cost = list(counts), 0
    heapq.heapify(h)
    while len(h) > 1:
        x = heapq.heappop(h) + heapq.heappop(h)
        cost += x
        heapq.heappush(h, x)
    return cost


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(3)
    for n in (1, 2, 3, 10, 300):
        counts = {i: rng.randint(1, 1000) for i in range(n)}
        lengths = code_lengths(counts, 18)
        assert sum(2.0**-x for x in lengths.values()) <= 1
        if n > 1:
            assert sum(counts[s] * x for s, x in lengths.items()) == huffman_cost(counts.values())
    steep = {i: 2**i for i in range(40)}
    limited = code_lengths(steep, 8)
    assert max(limited.values()) <= 8 and sum(2.0**-x for x in limited.values()) <= 1
    with pytest.raises(ValueError):
        code_lengths(dict.fromkeys(range(5), 1), 2)


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000)
    counts = dict(zip(*[x.tolist() for x in np.unique(np.concatenate([ids, [1]]), return_counts=True)], strict=True))
    book = Codebook(code_lengths(counts))
    payload, checkpoints = book.encode(ids)
    assert (book.decode(payload, checkpoints, n) == ids).all()
    for k in range(len(checkpoints)):  # each block alone
        size = min(BLOCK, n - k * BLOCK)
        assert (book.decode(payload, checkpoints[k : k + 1], size) == ids[k * BLOCK : k * BLOCK + size]).all()


def test_files_against_the_tokenizer(spark, awkward, tokenizer, tmp_path):
    odd = awkward.withColumn("start", F.lit("clash")).withColumn("part", F.lit(1))
    write_tokens(odd, str(tmp_path / "t"), tokenizer_path(), segment_tokens=50)
    rows = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()), key=lambda r: r[1])
    assert got == plain(tokenizer, rows)


def test_corpus_sample_and_special_strings(spark, documents, tokenizer, tmp_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += ["a<|endoftext|>b <|startoftext|> C", "é   x y 　z​q", "line\x85break\x1cfield", "it's we'll 123 4a5 ①"]
    rows = list(enumerate(texts))
    write_tokens(documents(rows), str(tmp_path / "t"), tokenizer_path())
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()), key=lambda r: r[1])
    assert got == plain(tokenizer, rows)


def test_empty_table(spark, documents, tmp_path):
    write_tokens(documents([]), str(tmp_path / "t"), tokenizer_path())
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0
