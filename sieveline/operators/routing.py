"""Routing of texts to concepts by the keywords they contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dimensions import BANK_KEY_TO_CONCEPT, CONCEPTS, FAMILY_FALLBACK


def concept_scores(text: Column) -> Column:
    """array of struct(score, ord, concept), best first; a concept scores the lengths of its keys in the text."""
    one = lambda keys: sum((F.when(F.contains(text, F.lit(k)), len(k)).otherwise(0) for k in keys), F.lit(0))
    scored = F.array(*[F.struct((-one(keys)).cast("bigint").alias("s"), F.lit(i).alias("ord"), F.lit(c).alias("concept")) for i, (c, _, keys) in enumerate(CONCEPTS)])
    return F.transform(F.array_sort(scored), lambda x: F.struct((-x["s"]).alias("score"), x["ord"].alias("ord"), x["concept"].alias("concept")))


def route(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, concept (null where nothing or a tie is on top), score of the best, margin over the second."""
    ranked = rows.select(key, concept_scores(F.lower(text)).alias("r"))
    top, second = F.col("r")[0], F.col("r")[1]
    margin = top["score"] - second["score"]
    return ranked.select(key, F.when(margin > 0, top["concept"]).alias("concept"), top["score"].alias("score"), margin.alias("margin"))


def alternatives(rows: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """key, concept, seq, other: the n concepts to offer beside the best one, or from the best on where nothing or a tie is on top."""
    ranked = rows.select(key, concept_scores(F.lower(text)).alias("r"))
    sure = F.col("r")[0]["score"] > F.col("r")[1]["score"]
    others = F.when(sure, F.slice("r", 2, n)).otherwise(F.slice("r", 1, n))
    return ranked.select(key, F.when(sure, F.col("r")[0]["concept"]).alias("concept"), F.posexplode(others).alias("seq", "o")).select(key, "concept", "seq", F.col("o.concept").alias("other"))


def refine(routed: DataFrame, answers: DataFrame, key: str, calibrated: Column) -> DataFrame:
    """routed (key, concept) with `refined` by the answers (key, leaf, family, p, abstained, ord): the leaf of the largest p (the first on ties).

    Without an answer that does not abstain the family's fallback stands, and without calibration the routed concept.
    """
    said = ~F.col("abstained")
    best = answers.groupBy(key).agg(F.max_by("leaf", F.when(said, F.struct("p", -F.col("ord")))).alias("_leaf"), F.min_by("family", "ord").alias("_family"))
    found = F.coalesce(concept_for_bank_key(F.col("_leaf")), concept_for_family(F.col("_family")), F.col("concept"))
    return routed.join(best, key, "left").withColumn("refined", F.when(calibrated, found).otherwise(F.col("concept"))).drop("_leaf", "_family")


def concept_for_bank_key(key: Column) -> Column:
    names = [c for c, _, _ in CONCEPTS]
    out = F.when(key.isin(*names), key)
    for k, c in BANK_KEY_TO_CONCEPT.items():
        out = out.when(key == k, c)
    return out


def concept_for_family(family: Column) -> Column:
    fallback = F.lit(None).cast("string")
    for f, c in FAMILY_FALLBACK.items():
        fallback = F.when(family == f, c).otherwise(fallback)
    return F.coalesce(F.when(family.isin(*[c for c, _, _ in CONCEPTS]), family), fallback)


def search_concepts(concepts: DataFrame, query: str, limit: int = 9) -> DataFrame:
    """Concepts whose name or a key contains the query, case-insensitively; at most `limit` (a report)."""
    q = query.strip().lower()
    hits = concepts.where(F.contains(F.lower("concept"), F.lit(q)) | F.contains(F.lower("key"), F.lit(q)))
    return hits.groupBy("concept", "ord").agg(F.count(F.lit(1)).alias("keys")).orderBy("ord").limit(limit)
