"""Evaluation of predictions, release gates and agreement of two prediction sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds a release has to clear.
GATES = {
    "accuracy_overall": 0.8, "accuracy_per_language_min": 0.7, "ece_overall_max": 0.12, "ece_per_bucket_max": 0.2, "noul_accuracy_min": 0.85,
    "choice_accuracy_min": 0.75, "precision_pay_to_withdraw_min": 0.8, "recall_pay_to_withdraw_min": 0.8, "recall_impersonation_min": 0.85,
    "false_positive_rate_negatives_max": 0.1, "abstention_coverage_min": 0.55, "quantized_agreement_min": 0.95,
}


def rate(hit: Column, among: Column) -> Column:
    """Share of rows with `hit` among rows with `among`; null if there are none."""
    return F.count_if(hit & among) / F.nullif(F.count_if(among), F.lit(0))


def metrics_by(scored: DataFrame, *dims: str) -> DataFrame:
    """dimension, value, n, accuracy, brier, negative_error_rate: overall and by each dimension, in one pass of grouping sets."""
    right = F.col("correct") == 1
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.pow(F.col("conf") - F.col("correct"), F.lit(2.0))).alias("brier"), rate(~right, F.col("negative")).alias("negative_error_rate"),
    ]
    keys = [F.col(d) for d in dims]
    sets = scored.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.grouping_id(*keys).alias("_g"), *aggs)
    full = (1 << len(dims)) - 1
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        on = F.col("_g") == full - (1 << (len(dims) - 1 - i))
        name, value = F.when(on, d).otherwise(name), F.when(on, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n", "accuracy", "brier", "negative_error_rate")


def gates(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """name, value, threshold, ok from metrics (name, value); a gate without a metric fails. Names that end in _max are ceilings."""
    table = {**GATES, **{k: v for k, v in (thresholds or {}).items() if not k.startswith("_")}}
    rows = metrics.sparkSession.createDataFrame(list(table.items()), "name string, threshold double")
    joined = rows.join(F.broadcast(metrics), "name", "left")
    ok = F.when(F.col("name").endswith("_max"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return joined.select("name", "value", "threshold", F.coalesce(ok, F.lit(False)).alias("ok"))


def agreement(pairs: DataFrame, margin: float = 0.02) -> DataFrame:
    """n, top1, decisive_top1, n_decisive, mean_abs_delta, mean_kl over rows with logits a and b of equal length."""
    from ..functions.decode import argmax, softmax

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda u, v: u + v)
    p, q = softmax(F.col("a")), softmax(F.col("b"))
    rows = pairs.select(
        (argmax(F.col("a")) == argmax(F.col("b"))).alias("same"), (total(F.zip_with("a", "b", lambda x, y: F.abs(x - y))) / F.size("a")).alias("delta"),
        total(F.zip_with(p, q, lambda x, y: x * F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(y, F.lit(1e-9))))).alias("kl"), F.sort_array(p, asc=False).alias("s"),
    )
    decisive = (F.size("s") < 2) | (F.col("s")[0] - F.try_element_at("s", F.lit(2)) >= margin)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("same").cast("double")).alias("top1"), rate(F.col("same"), decisive).alias("decisive_top1"), F.count_if(decisive).alias("n_decisive"),
        F.avg("delta").alias("mean_abs_delta"), F.avg("kl").alias("mean_kl"),
    )
