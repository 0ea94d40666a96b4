"""Queries that decode and judge predictions, each with its SQL. Logits are stand-ins taken from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals, predictions
from ..sources import dimensions as dim
from .model_queries import _L, _M, _confidence, _labelled, _scored

_NOUL = ("pay_to_withdraw", "otp", "secrecy", "selling")
_BY_BUCKET, _BY_TYPE, _CUTS = {"noul:2": 2.0, "choice:6-10": 1.5}, (1.0, 3.0, 1.0), {"noul:2": 0.6, "default": 0.3}


def _map(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _questions(spark, d):
    """One question per vector: two options are yes or no, four a score, more a choice; Hindi rows show their options rotated by one."""
    rows = _labelled(spark, d)
    kind = F.when(F.col("k") == 2, "noul").when(F.col("k") == 4, "score").otherwise("choice")
    qid = F.when(F.col("k") == 2, F.element_at(F.array(*map(F.lit, _NOUL)), (F.pmod(F.floor(F.col("vec_id") / 4), F.lit(4)) + 1).cast("int"))).otherwise(F.concat(F.lit("q"), F.pmod("vec_id", F.lit(3)).cast("string")))
    keys = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    order = F.when(F.col("lang") == "hi", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.pmod(i + 1, F.col("k"))))
    gold = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(i == F.col("gold"), 1.0).otherwise(0.0))
    return rows.select(F.col("vec_id").alias("row_id"), qid.alias("qid"), kind.alias("kind"), keys.alias("keys"), order.alias("option_order"), gold.alias("gold"), "lang", "task", "negative")


def _logits(spark, d):
    rows = _scored(spark, d).withColumnRenamed("vec_id", "row_id").where(F.pmod("row_id", F.lit(7)) != 0)
    return rows.join(_questions(spark, d).select("row_id", "qid"), "row_id").select("row_id", "qid", F.concat("logits", F.array(F.lit(99.0))).alias("logits"))


def _decoded(spark, d):
    q = _questions(spark, d)
    return predictions.decode_predictions(q.drop("gold"), _logits(spark, d), _map(_BY_BUCKET), F.array(*map(F.lit, _BY_TYPE)), _map(_CUTS))


def _judged(spark, d):
    return predictions.judged(_decoded(spark, d), _questions(spark, d))


def decode_predictions(spark, d):
    rows = _decoded(spark, d)
    return rows.select("row_id", "qid", "bucket", "abstained", F.posexplode(F.arrays_zip("keys", "p")).alias("i", "x")).select("row_id", "qid", "bucket", "abstained", F.col("x.keys").alias("option"), F.round("x.p", 8).alias("p"))


_D = f"""{_L}, q AS (SELECT vec_id AS row_id, k, gold, list_transform(z, lambda v: v / CASE k WHEN 2 THEN 2.0 WHEN 4 THEN 3.0 WHEN 8 THEN 1.5 ELSE 1.0 END) AS z,
  CASE k WHEN 2 THEN ['pay_to_withdraw', 'otp', 'secrecy', 'selling'][vec_id // 4 % 4 + 1] ELSE 'q' || vec_id % 3 END AS qid, CASE k WHEN 2 THEN 'noul' WHEN 4 THEN 'score' ELSE 'choice' END AS kind,
  CASE k WHEN 2 THEN 'noul:2' WHEN 4 THEN 'score:3-5' WHEN 8 THEN 'choice:6-10' ELSE 'choice:11+' END AS bucket, ['en', 'hi', 'mr', 'ta', 'bn'][vec_id % 5 + 1] AS lang, vec_id % 10 < 3 AS negative FROM l WHERE vec_id % 7 <> 0),
e AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM q),
s AS (SELECT *, list_transform(x, lambda v: v / list_sum(x)) AS slots FROM e),
p AS (SELECT *, CASE WHEN lang = 'hi' THEN list_transform(range(0, k), lambda j: slots[(j - 1 + k) % k + 1]) ELSE slots END AS p FROM s),
c AS (SELECT *, list_max(p) AS conf, (list_position(p, list_max(p)) - 1 = gold)::INTEGER AS correct, list_max(p) < CASE k WHEN 2 THEN 0.6 ELSE 0.3 END AS abstained FROM p)"""
_DECODE = f"WITH {_D} SELECT row_id, qid, bucket, abstained, 'o' || i AS option, round(p[i + 1], 8) AS p FROM (SELECT *, unnest(range(0, k)) AS i FROM c)"


def eval_metrics(spark, d):
    return predictions.metrics(_judged(spark, d)).select("name", F.round("value", 6).alias("value"))


_SHARE = "round(count(CASE WHEN {among} AND {hit} THEN 1 END) / nullif(count(CASE WHEN {among} THEN 1 END), 0)::DOUBLE, 6)"
_METRICS = f"""WITH {_D}, y AS (SELECT *, kind = 'noul' AND p[2] >= 0.5 AS yes, kind = 'noul' AND gold = 1 AS gold_yes FROM c),
b AS (SELECT greatest(1, len(list_filter(range(0, 16), lambda i: i / 15.0::DOUBLE < conf))) AS bin, count(*) AS n, sum(conf) AS s, sum(correct) AS k FROM c GROUP BY 1)
SELECT unnest(['accuracy_overall', 'choice_accuracy_min', 'noul_accuracy_min', 'score_mae', 'brier', 'precision_pay_to_withdraw_min', 'recall_pay_to_withdraw_min', 'recall_impersonation_min', 'false_positive_rate_negatives_max', 'n', 'n_negatives']) AS name,
  unnest([round(avg(correct), 6), {_SHARE.format(among="kind = 'choice'", hit="correct = 1")}, {_SHARE.format(among="kind = 'noul'", hit="yes = gold_yes")},
  round(avg(CASE WHEN kind = 'score' THEN abs(list_sum(list_transform(range(0, k), lambda i: i * p[i + 1])) - gold) END), 6), round(avg(pow(conf - correct, 2)), 6),
  {_SHARE.format(among="qid = 'pay_to_withdraw' AND yes", hit="gold_yes")}, {_SHARE.format(among="qid = 'pay_to_withdraw' AND gold_yes", hit="yes")},
  {_SHARE.format(among="qid IN ('otp', 'secrecy') AND gold_yes", hit="yes")}, {_SHARE.format(among="negative", hit="correct = 0")}, count(*)::DOUBLE, count(CASE WHEN negative THEN 1 END)::DOUBLE]) AS value FROM y
UNION ALL SELECT 'ece_overall_max', round(sum(abs(s - k)) / sum(n), 6) FROM b"""


def worst_groups(spark, d):
    return predictions.worst_groups(_judged(spark, d)).select("name", F.round("value", 6).alias("value"), "worst")


_WORST = f"""WITH {_D}, l2 AS (SELECT lang, avg(correct) AS v FROM c GROUP BY lang),
b AS (SELECT bucket, greatest(1, len(list_filter(range(0, 16), lambda i: i / 15.0::DOUBLE < conf))) AS bin, count(*) AS n, sum(conf) AS s, sum(correct) AS k FROM c GROUP BY 1, 2),
g AS (SELECT bucket, sum(abs(s - k)) / sum(n) AS v FROM b GROUP BY bucket)
(SELECT 'accuracy_per_language_min' AS name, round(v, 6) AS value, lang AS worst FROM l2 ORDER BY v, lang LIMIT 1) UNION ALL (SELECT 'ece_per_bucket_max', round(v, 6), bucket FROM g ORDER BY v DESC, bucket LIMIT 1)"""


def gate_failures(spark, d):
    rows = _judged(spark, d)
    found = predictions.metrics(rows).unionByName(predictions.worst_groups(rows).drop("worst"))
    return predictions.failures(evals.gates(found, {"accuracy_overall": 0.05})).select("passed", F.array_join("failures", ",").alias("failures"))


_FAILURES = f"""WITH v AS (SELECT name, value FROM ({_METRICS}) UNION ALL SELECT name, value FROM ({_WORST})),
g AS (SELECT g.name, coalesce(CASE WHEN g.name LIKE '%\\_max' ESCAPE '\\' THEN value <= threshold ELSE value >= threshold END, false) AS ok FROM (SELECT * FROM {dim.sql_values(list((evals.GATES | {"accuracy_overall": 0.05}).items()), "g(name, threshold)")}) g LEFT JOIN v USING (name))
SELECT bool_and(ok) AS passed, coalesce(string_agg(CASE WHEN NOT ok THEN name END, ',' ORDER BY name), '') AS failures FROM g"""


def ece_report(spark, d):
    return predictions.ece_report(_confidence(spark, d)).select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("ece", "mean_confidence", "accuracy")])


_REPORT = f"""WITH {_M}, r AS (SELECT bucket, conf, correct FROM c UNION ALL SELECT 'overall', conf, correct FROM c),
b AS (SELECT bucket, greatest(1, len(list_filter(range(0, 16), lambda i: i / 15.0::DOUBLE < conf))) AS bin, count(*) AS n, sum(conf) AS s, sum(correct) AS k FROM r GROUP BY 1, 2)
SELECT bucket, sum(n)::BIGINT AS n, round(sum(abs(s - k)) / sum(n), 6) AS ece, round(sum(s) / sum(n), 6) AS mean_confidence, round((sum(k) / sum(n))::DOUBLE, 6) AS accuracy FROM b GROUP BY 1"""


def risk_coverage(spark, d):
    return predictions.risk_coverage(_labelled(spark, d), "lang").select("lang", "n", *[F.round(c, 6).alias(c) for c in ("aurc", "selective_50", "selective_80")])


_RISK = f"""WITH {_M}, u AS (SELECT lang, conf, count(*) OVER w AS n, sum(1 - correct) OVER w AS e, count(*) OVER (PARTITION BY lang) AS total FROM m WINDOW w AS (PARTITION BY lang ORDER BY conf DESC RANGE UNBOUNDED PRECEDING))
SELECT lang, count(*) AS n, round(avg(e / n::DOUBLE), 6) AS aurc, round(1 - max_by(e / n::DOUBLE, CASE WHEN n >= ceil(0.5 * total) THEN conf END), 6) AS selective_50,
  round(1 - max_by(e / n::DOUBLE, CASE WHEN n >= ceil(0.8 * total) THEN conf END), 6) AS selective_80 FROM u GROUP BY lang"""


QUERIES = {
    "decode_predictions": (decode_predictions, _DECODE),
    "eval_metrics": (eval_metrics, _METRICS),
    "worst_groups": (worst_groups, _WORST),
    "gate_failures": (gate_failures, _FAILURES),
    "ece_report": (ece_report, _REPORT),
    "risk_coverage": (risk_coverage, _RISK),
}
