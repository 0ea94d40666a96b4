"""Seeded market paths with a crash, and what holding or selling in panic is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dashboard import mulberry32

# Paths, trading days a year, drift, volatility, the shock and the panic rule.
PATHS, DAYS, DRIFT, VOLATILITY, SHOCK, SHOCK_DAYS, PANIC, DEPOSIT = 40, 252, 0.11, 0.18, 0.009, 40, 75.0, 1.065


def paths(spark: SparkSession, seed: int, years: int) -> DataFrame:
    """path, i, value: 100 at the start; two draws of the generator a step, by position, so that steps need no order."""
    n = years * DAYS
    crash = int(n * 0.3)
    steps = spark.range(PATHS * n).select((F.col("id") / n).cast("int").alias("path"), F.pmod("id", F.lit(n)).cast("int").alias("i"), "id")
    u, v = mulberry32(seed, F.col("id") * 2 + 1), mulberry32(seed, F.col("id") * 2 + 2)
    z = F.sqrt(-2 * F.log(u + 1e-12)) * F.cos(2 * F.pi() * v)
    move = F.lit(DRIFT / DAYS) + F.lit(VOLATILITY / DAYS**0.5) * z - F.when(F.col("i").between(crash, crash + SHOCK_DAYS - 1), SHOCK).otherwise(0.0)
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("path", "i", move.alias("move")).select("path", "i", (100 * F.exp(F.sum("move").over(w))).alias("value"))


def outcome(rows: DataFrame, years: int) -> DataFrame:
    """hold, panic: mean final value, and with those who sell at the first value under the panic line after the crash began."""
    n = years * DAYS
    crash = int(n * 0.3)
    ends = rows.groupBy("path").agg(F.max_by("value", "i").alias("final"), F.min_by(F.col("value"), F.when((F.col("i") > crash) & (F.col("value") < PANIC), F.col("i"))).alias("sold"))
    return ends.agg(F.avg("final").alias("hold"), F.avg(F.coalesce(F.col("sold") * DEPOSIT ** ((n - crash) / DAYS), F.col("final"))).alias("panic"))
