"""Queries over question banks, training items and concept alternatives, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import banks, dataset, fusion, routing, tier0, tokenizer
from ..sources import files
from ..sources.dimensions import FOLLOWUP_DEFAULT, FOLLOWUP_WEIGHTS, FOLLOWUP_YES
from ..sources.messages import messages
from .message_queries import _ANSWERS, _LEX, _NORM, _SCORES, _answers, _norm


def _bank_json(spark, d):
    """One JSON question per part, of eight makes, some of which break rules."""
    p = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey").cast("string")
    makes = (
        '"type":"choice","instructions":"Pick one","criteria":{"a":"first","b":"second","c":"third"}', '"type":"choice","instructions":"Pick","criteria":{"":"no name","b":"x"},"triage_key":"t1"',
        '"type":"score","instructions":"How much","criteria":["low","mid","high"],"triage_key":"t1"', '"type":"score","instructions":"","criteria":["only"],"triage_key":"t2"',
        '"type":"noul","instructions":"Is it","triage_key":"t1","labels":{"false":" no ","true":"yes"}', '"type":"noul","instructions":"Is\\nit","criteria":{"maybe":"?"},"triage_key":"t9"',
        '"type":"noul","instructions":"Is it so","labels":{"false":"x","true":"x"},"triage_key":"t2"', '"type":"rank","instructions":"Order"',
    )
    body = F.element_at(F.array(*map(F.lit, makes)), (F.pmod("p_partkey", F.lit(8)) + 1).cast("int"))
    bank = F.concat(F.lit("bank"), F.pmod("p_partkey", F.lit(3)).cast("string"))
    return p.select(F.concat(F.lit('{"bank":"'), bank, F.lit('","qid":"q'), key, F.lit('",'), body, F.lit("}")).alias("json"))


def _questions(spark, d):
    return banks.load_questions(_bank_json(spark, d), "json")


def bank_rules(spark, d):
    known = spark.createDataFrame([(f"bank{b}", t) for b in range(3) for t in ("t1", "t2")], "bank string, triage_key string")
    return banks.broken_rules(_questions(spark, d), known)


_Q = "q AS (SELECT 'bank' || p_partkey % 3 AS bank, 'q' || p_partkey AS qid, p_partkey % 8 AS k FROM part)"
_RULES = f"""WITH {_Q} SELECT bank, qid, rule FROM q JOIN (VALUES (1, 'empty_key'), (3, 'options'), (3, 'instructions'), (5, 'noul_keys'), (5, 'instructions'), (5, 'triage_key'), (6, 'labels'), (7, 'type')) r(n, rule) ON n = k"""


def option_keys(spark, d):
    rows = _questions(spark, d).where(F.col("kind") != "rank")
    labels = banks.noul_labels(F.col("labels"))
    return rows.select("qid", F.posexplode(banks.option_keys(F.col("kind"), F.col("criteria"), F.col("levels"))).alias("i", "key"), F.concat_ws("/", labels["no"], labels["yes"]).alias("labels"))


_KEYS = f"""WITH {_Q}, o AS (SELECT qid, k, CASE k WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['', 'b'] WHEN 2 THEN ['0', '1', '2'] WHEN 3 THEN ['0'] ELSE ['false', 'true'] END AS keys FROM q WHERE k < 7)
SELECT qid, (i - 1)::INTEGER AS i, keys[i] AS key, CASE k WHEN 4 THEN 'no/yes' WHEN 6 THEN '' ELSE 'false/true' END AS labels FROM o, range(1, 4) t(i) WHERE i <= len(keys)"""


def bank_most_questions(spark, d):
    return banks.most_questions(_questions(spark, d))


_MOST = f"""WITH {_Q}, c AS (SELECT bank, CASE WHEN k IN (1, 2, 4) THEN 't1' WHEN k IN (3, 6) THEN 't2' WHEN k = 5 THEN 't9' END AS t, count(*) AS n FROM q GROUP BY 1, 2) SELECT bank, max(CASE WHEN t IS NULL THEN 0 ELSE n END) + 1 AS most FROM c GROUP BY bank"""


def canonical_shas(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    fields = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return p.select("p_partkey", banks.canonical_sha(fields).alias("sha"), banks.without_mask(F.col("p_name"), "a").alias("scrubbed"))


_SHAS = """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":"' || p_size || '","type":"' || p_type || '"}') AS sha, replace(p_name, 'a', ' ') AS scrubbed FROM part"""


def concept_alternatives(spark, d):
    return routing.alternatives(_norm(spark, d), "msg_id", "norm").groupBy("concept", "seq", "other").agg(F.count(F.lit(1)).alias("n"))


_OTHERS = f"""WITH {_NORM}, s AS (SELECT {_SCORES} AS r FROM norm), a AS (SELECT CASE WHEN r[1].s < r[2].s THEN r[1].c END AS concept, CASE WHEN r[1].s < r[2].s THEN r[2:4] ELSE r[1:3] END AS o FROM s)
SELECT concept, i::INTEGER AS seq, o[i + 1].c AS other, count(*) AS n FROM a, range(0, 3) t(i) GROUP BY 1, 2, 3"""


def concept_refinement(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    leaves = ("sip", "vip_tips", "nav", "fraud_report", "unknown_leaf")
    answers = e.where("event_type <> 'click'").select(F.col("user_id"), F.element_at(F.array(*map(F.lit, leaves)), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("leaf"), F.element_at(F.array(*map(F.lit, ("basics", "costs", "none"))), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("family"), (F.pmod("event_id", F.lit(37)) / 37).alias("p"), (F.pmod("event_id", F.lit(2)) == 0).alias("abstained"), F.col("event_id").alias("ord"))
    routed = e.select("user_id").distinct().withColumn("concept", F.when(F.pmod("user_id", F.lit(2)) == 0, "volatility"))
    return routing.refine(routed, answers, "user_id", F.pmod("user_id", F.lit(7)) != 0)


_REFINE = """WITH a AS (SELECT user_id, event_id, ['sip', 'vip_group', 'nav', 'digital_arrest', NULL][event_id % 5 + 1] AS leaf, event_id % 37 AS p, event_id % 2 = 0 AS abstained FROM events WHERE event_type <> 'click'),
b AS (SELECT user_id, count(*) AS n, arg_max(coalesce(leaf, '-'), p * 1000000000::BIGINT - event_id) FILTER (WHERE NOT abstained) AS leaf FROM a GROUP BY user_id),
u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'volatility' END AS concept FROM events)
SELECT user_id, concept, CASE WHEN user_id % 7 <> 0 THEN coalesce(nullif(leaf, '-'), CASE WHEN n IS NOT NULL THEN ['nav', 'expense_ratio', NULL][user_id % 3 + 1] END, concept) ELSE concept END AS refined FROM u LEFT JOIN b USING (user_id)"""


def _items(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = F.pmod("doc_id", F.lit(7)) + 2
    rows = docs.select("doc_id", "source", dataset.split_of(F.col("doc_id").cast("string")).alias("split"), F.col("lang").alias("task"), F.sequence(F.lit(1).cast("bigint"), n).alias("ids"), F.sequence(F.lit(0).cast("bigint"), F.pmod("doc_id", F.lit(3))).alias("markers"))
    return rows.withColumn("keys", F.sequence(F.lit(0).cast("bigint"), F.pmod("doc_id", F.lit(2)) + 1))


def training_items(spark, d):
    kept = dataset.unclamped(dataset.eligible(_items(spark, d), ("en", "de"), ("train", "val")), "markers", "keys")
    return kept.groupBy("split", "task").agg(F.count(F.lit(1)).alias("n"), F.sum(dataset.first_best(F.transform("ids", lambda i: F.pmod(i * 5, F.lit(7))))).alias("labels"))


def collated_batches(spark, d):
    rows = dataset.collate(_items(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 5)), "batch", "ids", "markers", 0)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select("doc_id", *[text(c).alias(c) for c in ("ids", "markers", "ids_mask", "markers_mask")])


_COLLATE = """WITH i AS (SELECT doc_id, doc_id // 5 AS b, doc_id % 7 + 2 AS n, doc_id % 3 + 1 AS m FROM documents), s AS (SELECT *, max(n) OVER (PARTITION BY b) AS mn, max(m) OVER (PARTITION BY b) AS mm FROM i)
SELECT doc_id, array_to_string(list_transform(range(1, mn + 1), lambda x: CASE WHEN x <= n THEN x ELSE 0 END), ' ') AS ids, array_to_string(list_transform(range(0, mm), lambda x: CASE WHEN x < m THEN x ELSE 0 END), ' ') AS markers,
  array_to_string(list_transform(range(1, mn + 1), lambda x: (x <= n)::INTEGER), ' ') AS ids_mask, array_to_string(list_transform(range(0, mm), lambda x: (x < m)::INTEGER), ' ') AS markers_mask FROM s"""


def rank_shards(spark, d):
    return dataset.rank_shards(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", "rank", "step")


def held_out_rows(spark, d):
    rows = dataset.hold_out(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", 11)
    return rows.groupBy("lang", "held_out").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def fused_evidence(spark, d):
    rows = tier0.tier0(messages(spark, d)).select("msg_id", "evidence")
    out = fusion.all_evidence(rows, _answers(messages(spark, d).select("msg_id")))
    return out.select(F.explode("evidence").alias("e")).groupBy("e.code", "e.source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e.weight"), 4).alias("weight")).where("source = 'model'")


_FUSED = f"""WITH {_NORM}, {_ANSWERS}, w AS (SELECT upper(qid) AS code, CASE qid {" ".join(f"WHEN '{q}' THEN {w}" for q, w in FOLLOWUP_WEIGHTS.items())} ELSE {FOLLOWUP_DEFAULT} END::DOUBLE AS weight FROM answers WHERE NOT abstained AND noul >= {FOLLOWUP_YES})
SELECT code, 'model' AS source, count(*) AS n, round(sum(weight), 4) AS weight FROM w GROUP BY code"""


def family_order(spark, d):
    rows = tier0.family_map(tier0.automaton_hits(_norm(spark, d), "msg_id"), "msg_id")
    return rows.select("msg_id", "seq", "family", "detail")


_ORDER = f"""WITH {_NORM}, h AS (SELECT msg_id, family, term, strpos(norm, term) + length(term) AS pos FROM norm JOIN {_LEX} ON contains(norm, term)),
t AS (SELECT msg_id, family, min(pos) AS pos, list(term ORDER BY pos, term) AS terms FROM h GROUP BY 1, 2)
SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY pos, family) - 1)::INTEGER AS seq, family, array_to_string(terms[1:3], ', ') AS detail FROM t"""


def parity_replay(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    z = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    made = e.where("vec_id % 97 <> 1").select("vec_id", F.array(F.col("vec_id"), F.when(F.pmod("vec_id", F.lit(41)) == 0, 0).otherwise(F.col("label"))).alias("ids"), F.transform(z, lambda x: F.round(x, 1)).alias("logits"))
    out = tokenizer.parity(e.select("vec_id", F.array(F.col("vec_id"), F.col("label").cast("bigint")).alias("ids"), z.alias("logits")), made, "vec_id", 0.35)
    return out.select("ids_wrong", F.round("max_delta", 6).alias("max_delta"), F.round("top1", 6).alias("top1"), "vectors", "ok")


_PARITY = """WITH v AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS z FROM embeddings), w AS (SELECT *, list_transform(z, lambda x: round(x, 1)) AS y, vec_id % 97 = 1 AS lost FROM v),
r AS (SELECT lost OR (vec_id % 41 = 0 AND label <> 0) AS wrong, CASE WHEN NOT lost THEN list_max(list_transform(range(1, 9), lambda i: abs(z[i] - y[i]))) END AS delta, CASE WHEN NOT lost THEN list_position(z, list_max(z)) = list_position(y, list_max(y)) END AS same FROM w)
SELECT count(CASE WHEN wrong THEN 1 END) AS ids_wrong, round(max(delta), 6) AS max_delta, round(avg(same::INTEGER), 6) AS top1, count(*) AS vectors, count(CASE WHEN wrong THEN 1 END) = 0 AND max(delta) <= 0.35 AS ok FROM r"""


def manifests(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    rows = s.select(F.col("s_name").alias("modelVersion"), F.lit(512).alias("maxLen"), F.lit(128).alias("headMaxLen"), F.array(F.col("s_suppkey") / 4, F.lit(1.0), F.lit(9.0)).alias("temperature"),
        F.create_map(F.lit("noul:2"), F.lit(0.25), F.lit("choice:2"), F.col("s_suppkey") / 2).alias("temperatureByBucket"), F.create_map(F.lit("default"), F.lit(0.123456)).alias("abstain"))
    return files.build_manifest(rows, {"evals": "none"})


_MANIFESTS = """SELECT '{"schema":2,"modelVersion":"' || s_name || '","maxLen":512,"headMaxLen":128,"qtypes":{"choice":0,"score":1,"noul":2},"temperature":[' || greatest(0.5::DOUBLE, least(5.0::DOUBLE, s_suppkey / 4.0::DOUBLE)) || ',1.0,5.0],"temperatureByBucket":{"choice:2":' || greatest(0.5::DOUBLE, least(5.0::DOUBLE, s_suppkey / 2.0::DOUBLE)) || ',"noul:2":0.5},"abstain":{"default":0.1235},"evals":"none"}' AS json FROM supplier"""

_U = "(('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

QUERIES = {
    "fused_evidence": (fused_evidence, _FUSED),
    "family_order": (family_order, _ORDER),
    "parity_replay": (parity_replay, _PARITY),
    "manifests": (manifests, _MANIFESTS),
    "bank_rules": (bank_rules, _RULES),
    "option_keys": (option_keys, _KEYS),
    "bank_most_questions": (bank_most_questions, _MOST),
    "canonical_shas": (canonical_shas, _SHAS),
    "concept_alternatives": (concept_alternatives, _OTHERS),
    "concept_refinement": (concept_refinement, _REFINE),
    "training_items": (training_items, "WITH i AS (SELECT doc_id, lang AS task, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS b, list_transform(range(1, doc_id % 7 + 3), lambda x: x * 5 % 7) AS t FROM documents WHERE doc_id % 3 + 1 = doc_id % 2 + 2) SELECT CASE WHEN b < 70 THEN 'train' ELSE 'val' END AS split, task, count(*) AS n, sum(list_position(t, list_max(t)) - 1)::BIGINT AS labels FROM i WHERE b < 85 AND task IN ('en', 'de') GROUP BY 1, 2"),
    "collated_batches": (collated_batches, _COLLATE),
    "rank_shards": (rank_shards, "SELECT o_orderkey, r % 7 AS rank, r // 7 AS step FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r < n - n % 7"),
    "held_out_rows": (held_out_rows, f"SELECT lang, {_U.format(chr(39) + chr(39) + ' || doc_id || ' + chr(39) + '|11' + chr(39))} < 0.1 AS held_out, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1, 2"),
}
