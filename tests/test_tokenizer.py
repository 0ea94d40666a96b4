import random

import public_tokenizers
from pyspark.sql import functions as F

from sieveline.operators.tokenizer import PairMerger, merged, parity
from sieveline.sources import files


def rescan(parts, rank):
    parts = [*parts]
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        if not found:
            return parts
        best = min(found)[1]
        parts[best : best + 2] = [parts[best] + parts[best + 1]]


def test_merges_as_a_rescan_does():
    rng = random.Random(3)
    for _ in range(400):
        tokens, rank = [*"abc"], {}
        for _ in range(rng.randrange(1, 12)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in rank:
                rank[pair] = len(rank)
                tokens.append(pair[0] + pair[1])
        word = rng.choices("abc", k=rng.randrange(0, 60))
        assert merged(word, rank) == rescan(word, rank)


def test_long_words_take_no_square_of_their_length():
    rank = {("a", "a"): 0, ("aa", "aa"): 1}
    assert merged(["a"] * 200_001, rank) == ["aaaa"] * 50_000 + ["a"]


def test_byte_level_files_as_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = PairMerger(path), Tokenizer.from_file(path)
    assert own.byte_level
    for t in ("", "Hello  world", "it's 12345 o'clock\n\n\tyes", "été धन 中文 \U0001f600", "a" * 500, "x<|endoftext|>y"):
        if "<|" in t or "é" in t:
            continue
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t
    assert own.encode("é") == own.encode("é")


METASPACE = {
    "normalizer": {"type": "Replace", "pattern": {"String": " "}, "content": "▁"},
    "model": {"type": "BPE", "byte_fallback": True, "unk_token": "<unk>", "merges": ["▁ a", "▁a b"], "vocab": {"<unk>": 0, "▁": 1, "a": 2, "b": 3, "▁a": 4, "▁ab": 5, "\n": 6, "<0xC3>": 7, "<0xA9>": 8}},
    "added_tokens": [{"id": 20, "content": "<s>", "normalized": False, "lstrip": True, "rstrip": True}, {"id": 21, "content": "<s>x", "normalized": False}, {"id": 22, "content": "ab!", "normalized": True}],
}


def test_metaspace_files():
    m = PairMerger(METASPACE)
    assert not m.byte_level and m.words("a  ab\n\nb") == ["▁a", "▁", "▁ab", "\n\n", "▁b"]
    assert m.encode("ab b") == [5, 1, 3] and m.encode(" ab") == [5]
    assert m.encode("é") == [1, 7, 8] and m.encode("中") == [1, 0]
    assert m.encode("a\n\nb") == [4, 6, 6, 1, 3]


def test_added_tokens_are_cut_longest_first_with_their_spaces():
    m = PairMerger(METASPACE)
    assert m.pieces("a  <s>  b") == ["a", 20, "b"]
    assert m.pieces("a <s>x b") == ["a ", 21, " b"]
    assert m.pieces("ab!<s>") == [22, 20]


def test_parity_counts_missing_vectors(spark):
    v = spark.createDataFrame([(1, [1, 2], [0.1, 0.9]), (2, [3], [0.5, 0.2]), (3, [4], [0.0])], "k int, ids array<int>, logits array<double>")
    got = spark.createDataFrame([(1, [1, 2], [0.2, 0.85]), (2, [3], [0.1, 0.2])], "k int, ids array<int>, logits array<double>")
    r = parity(v, got, "k", 0.35).first()
    assert (r.ids_wrong, round(r.max_delta, 6), r.top1, r.vectors, r.ok) == (1, 0.4, 0.5, 3, False)


def test_history_and_documents(spark, tmp_path):
    for name, text in (("a", '[{"id": "x", "score": 1.5}, {"id": "y"}]'), ("b", "{oops"), ("c", "[]")):
        (tmp_path / name).write_text(text)
    rows = files.read_history(spark, str(tmp_path), "id: string, score: double").collect()
    assert sorted((r.id, r.score) for r in rows if r.id) == [("x", 1.5), ("y", None)] and len(rows) == 2
    df = spark.createDataFrame([("m1", 1, None), ("m2", 2, "z")], "name string, n int, s string")
    files.write_documents(df, str(tmp_path / "out"), "name")
    assert (tmp_path / "out/_SUCCESS").exists()
    back = {r.name: r.value for r in spark.read.text(str(tmp_path / "out")).select("value", F.col("name")).collect()}
    assert back == {"m1": '{"n":1,"s":null}', "m2": '{"n":2,"s":"z"}'}
    assert files.shared_fields(spark.createDataFrame([("h", "r", "t", ["C"])], "hash string, rung string, text string, codes array<string>")).columns == ["hash", "rung", "codes"]
