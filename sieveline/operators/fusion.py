"""Joining the deterministic verdict with calibrated model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dimensions import FOLLOWUP_DEFAULT, FOLLOWUP_WEIGHTS, FOLLOWUP_YES
from .tier0 import rung


def followup_weight(qid: Column) -> Column:
    out = F.lit(FOLLOWUP_DEFAULT)
    for k, w in FOLLOWUP_WEIGHTS.items():
        out = F.when(qid == k, w).otherwise(out)
    return out


def plan_followups(triage: DataFrame, bank: DataFrame, known: DataFrame, budget: int) -> DataFrame:
    """key, qid, ord: the first `budget` questions of a message's triage branch that are not known already.

    triage (key, triage_key), bank (triage_key, qid, ord), known (key, qid).
    """
    asked = triage.join(F.broadcast(bank), "triage_key").join(known, ["key", "qid"], "left_anti")
    order = Window.partitionBy("key").orderBy("ord")
    return asked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget).select("key", "qid", "ord")


def fuse(tier0: DataFrame, triage: DataFrame, answers: DataFrame, key: str = "msg_id") -> DataFrame:
    """key, score, families, rung, tier from the deterministic rows, triage (key, choice, abstained) and answers (key, qid, noul, abstained).

    Confident yes answers add weight and a family each. A confident "education" takes off 1.5 unless there is hard proof (an
    entry of weight 4), a score of 5.5 or a yes to selling. Without triage the deterministic verdict stands.
    """
    yes = ~F.col("abstained") & (F.col("noul") >= FOLLOWUP_YES)
    sums = answers.groupBy(key).agg(
        F.sum(F.when(yes, followup_weight(F.col("qid"))).otherwise(0.0)).alias("_add"), F.count_if(yes).alias("_extra"),
        F.max(F.when(F.col("qid") == "selling", F.coalesce("noul", F.lit(0.0))).otherwise(0.0)).alias("_selling"),
    )
    rows = tier0.select(key, "score", "families", "evidence").join(triage.select(key, F.col("choice").alias("_choice"), F.col("abstained").alias("_abstained")), key, "left").join(sums, key, "left")
    asked = F.col("_choice").isNotNull()
    added = F.when(asked, F.col("score") + F.coalesce("_add", F.lit(0.0))).otherwise(F.col("score"))
    proof = F.exists("evidence", lambda e: e["weight"] >= 4)
    soft = asked & ~F.col("_abstained") & (F.col("_choice") == "education") & ~proof & (F.col("_added") < 5.5) & (F.coalesce("_selling", F.lit(0.0)) < FOLLOWUP_YES)
    rows = rows.withColumn("_added", added).withColumn("_soft", soft)
    score = F.when(F.col("_soft"), F.greatest(F.lit(0.0), F.col("_added") - 1.5)).otherwise(F.col("_added"))
    families = F.col("families") + F.when(asked, F.coalesce("_extra", F.lit(0))).otherwise(0)
    return rows.select(key, score.alias("score"), families.cast("bigint").alias("families"), F.when(asked, "T0+T1").otherwise("T0").alias("tier")).withColumn("rung", rung(F.col("score"), F.col("families")))


def all_evidence(tier0: DataFrame, answers: DataFrame, key: str = "msg_id") -> DataFrame:
    """key, evidence: the deterministic entries (code, weight, source) followed by one for each confident yes, in order of qid."""
    yes = ~F.col("abstained") & (F.col("noul") >= FOLLOWUP_YES)
    entry = F.struct(F.upper("qid").alias("code"), followup_weight(F.col("qid")).cast("double").alias("weight"), F.lit("model").alias("source"))
    added = answers.where(yes).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_more"))
    own = F.transform("evidence", lambda e: F.struct(e["code"].alias("code"), e["weight"].cast("double").alias("weight"), e["source"].alias("source")))
    return tier0.join(added, key, "left").select(key, F.concat(own, F.coalesce("_more", F.array().cast("array<struct<code:string,weight:double,source:string>>"))).alias("evidence"))
