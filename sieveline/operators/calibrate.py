"""Calibration: temperature fits on a grid, expected calibration error, abstention cuts and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decode

ECE_BINS = 15


def records(predictions: DataFrame) -> DataFrame:
    """predictions with `target` made to sum to 1, uniform where it sums to nothing."""
    total = F.aggregate("target", F.lit(0.0), lambda a, b: a + b)
    return predictions.withColumn("target", F.when(total > 0, F.transform("target", lambda x: x / total)).otherwise(F.transform("target", lambda x: F.lit(1.0) / F.size("target"))))


def soft_cross_entropy(logits: Column, target: Column, t: Column) -> Column:
    """-sum(target * log softmax(logits / t))."""
    scaled = F.transform(logits, lambda x: x / t)
    top = F.array_max(scaled)
    log_sum = F.log(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return F.aggregate(F.zip_with(scaled, target, lambda x, y: y * (log_sum - x)), F.lit(0.0), lambda a, b: a + b)


def fit_temperatures(recs: DataFrame, group: str, grid: list[float], min_n: int) -> DataFrame:
    """group, temperature, loss: the grid value of least mean loss per group of at least min_n records; ties to the smaller.

    Each record is scored for the whole grid in its row; groups meet in one partial aggregation of grid-size sums.
    """
    tried = recs.select(group, F.explode(F.array(*map(F.lit, grid))).alias("t"), "logits", "target")
    loss = tried.groupBy(group, "t").agg(F.avg(soft_cross_entropy(F.col("logits"), F.col("target"), F.col("t"))).alias("loss"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    best = loss.groupBy(group).agg(F.min(F.struct(F.round("loss", 9).alias("l"), F.col("t").alias("t"))).alias("b"))
    return best.select(group, F.col("b.t").alias("temperature"), F.col("b.l").alias("loss"))


def refine_temperatures(recs: DataFrame, group: str, min_n: int, levels: int = 3, points: int = 33) -> DataFrame:
    """Like fit_temperatures, over log T in ever narrower grids around each group's best."""
    lo, hi = F.lit(decode.LOW_T), F.lit(decode.HIGH_T)
    bounds = recs.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n).select(group, F.log(lo).alias("a"), F.log(hi).alias("b"))
    for _ in range(levels):
        steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (points - 1))
        grid = bounds.select(group, "a", "b", F.explode(steps).alias("lt"))
        loss = recs.join(F.broadcast(grid), group).groupBy(group, "a", "b", "lt").agg(F.avg(soft_cross_entropy(F.col("logits"), F.col("target"), F.exp("lt"))).alias("loss"))
        best = loss.groupBy(group, "a", "b").agg(F.min_by("lt", "loss").alias("lt"))
        width = (F.col("b") - F.col("a")) / (points - 1)
        bounds = best.select(group, F.greatest(F.col("lt") - width, F.log(lo)).alias("a"), F.least(F.col("lt") + width, F.log(hi)).alias("b"), "lt")
    return bounds.select(group, F.exp("lt").alias("temperature"))


def ece_bin(conf: Column, bins: int = ECE_BINS) -> Column:
    """Position of the equal-width bin, closed above; the first is closed below too."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: i / F.lit(float(bins)))
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < conf)))


def ece(scored: DataFrame, *groups: str, bins: int = ECE_BINS) -> DataFrame:
    """groups, ece, n, mean_confidence, accuracy from rows with conf and correct (0 or 1), in two aggregations."""
    cells = scored.groupBy(*groups, ece_bin(F.col("conf"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("conf").alias("s"), F.sum(F.col("correct").cast("double")).alias("k"))
    return cells.groupBy(*groups).agg(
        (F.sum(F.abs(F.col("s") - F.col("k"))) / F.sum("c")).alias("ece"), F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean_confidence"), (F.sum("k") / F.sum("c")).alias("accuracy"),
    )


def abstention_cuts(scored: DataFrame, group: str, target_error: float = 0.15, min_n: int = 20, conservative: bool = True) -> DataFrame:
    """group, cut: the least confidence at which the (Wilson upper) error of all answers at or above it is within the target; else 1.

    Rows are first summed per distinct confidence, so that the window runs over distinct values only.
    """
    values = scored.groupBy(group, "conf").agg(F.count(F.lit(1)).alias("c"), F.sum(1 - F.col("correct").cast("int")).alias("e"))
    above = Window.partitionBy(group).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    sums = values.select(group, "conf", F.sum("c").over(above).cast("double").alias("n"), F.sum("e").over(above).cast("double").alias("errors"))
    err = decode.wilson_upper(F.col("errors"), F.col("n")) if conservative else F.col("errors") / F.col("n")
    best = sums.groupBy(group).agg(F.max("n").alias("n"), F.min(F.when(err <= target_error, F.col("conf"))).alias("cut"))
    return best.where(F.col("n") >= min_n).select(group, F.coalesce("cut", F.lit(1.0)).alias("cut"))


def coverage(scored: DataFrame, cut: Column) -> DataFrame:
    """coverage, selective_accuracy and n at a cut expression."""
    kept = F.col("conf") >= cut
    return scored.agg(
        F.avg(F.when(kept, 1.0).otherwise(0.0)).alias("coverage"), (F.count_if(kept & (F.col("correct") == 1)) / F.nullif(F.count_if(kept), F.lit(0))).alias("selective_accuracy"), F.count(F.lit(1)).alias("n"),
    )
