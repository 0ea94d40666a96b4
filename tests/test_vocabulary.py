import json

from tokenizers import Tokenizer

from sieveline.operators import dataset, vocabulary
from sieveline.plans import QUERIES
from sieveline.plans.model_queries import _tokenizer_file

D = "/root/testdata/sf0.001"


def plain_kept(tokenizer, texts):
    """By repeated passes over all merges."""
    data, tok = json.loads(tokenizer), Tokenizer.from_str(tokenizer)
    vocab = data["model"]["vocab"]
    keep = {i for t in texts for i in tok.encode(t, add_special_tokens=False).ids} | {a["id"] for a in data["added_tokens"]}
    keep |= {vocab[c] for t in texts for c in t if c in vocab}
    while True:
        more = {vocab[p] for a, b in data["model"]["merges"] if vocab.get(a + b) in keep for p in (a, b)} - keep
        if not more:
            return keep
        keep |= more


def test_kept_tokens_of_the_whole_corpus(spark):
    texts = [r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect() if r.text]
    rows = sorted(QUERIES["vocab_prune_corpus"][0](spark, D).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == sorted(plain_kept(_tokenizer_file(), texts)) and [r.new_id for r in rows] == list(range(len(rows)))
    assert 0 < len(rows) < len(json.loads(_tokenizer_file())["model"]["vocab"])


def test_drift_is_nothing_and_is_seen_where_the_closure_is_left_out(spark):
    docs, tokenizer = spark.read.parquet(f"{D}/documents.parquet"), _tokenizer_file()
    assert QUERIES["vocab_drift"][0](spark, D).first().asDict() == {"texts": docs.count(), "drifted": 0}
    used = {r.id for r in vocabulary.token_usage(docs, "text", tokenizer).collect() if r.id is not None}
    added = {a["id"] for a in json.loads(tokenizer)["added_tokens"]}
    assert vocabulary.drift(docs, "text", tokenizer, *vocabulary.pruned_file(tokenizer, used | added)).first().drifted > 0


def test_merge_chains_of_any_length_are_whole(spark):
    word = "".join(chr(0x4E00 + i) for i in range(101))
    merges = spark.createDataFrame([(word[:i], word[i], word[: i + 1]) for i in range(1, len(word))], "left string, right string, result string")
    kept = spark.createDataFrame([(word,)], "token string")
    assert {r.token for r in dataset.merge_closure(merges, kept).collect()} == {word[:i] for i in range(1, 102)} | set(word)
