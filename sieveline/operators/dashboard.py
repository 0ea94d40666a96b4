"""Dashboard aggregates and chart arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _imul(a: Column, b: Column) -> Column:
    """Product of two 32-bit numbers modulo 2**32, by halves so that it stays within a long."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftright(a, 16) * b.bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def mulberry32(seed: int, n: Column) -> Column:
    """The n-th number (from 1) of the seeded generator: its state is linear in n, so draws need no sequence."""
    s = (F.lit(seed).cast("bigint") + n * 0x6D2B79F5).bitwiseAND(F.lit(_MASK))
    t = _imul(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    u = (t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK))
    t = u.bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(2**32)


def period_change(rows: DataFrame, day: str, days: int, **measures: Column) -> DataFrame:
    """measure, current, previous, change: sums over the last `days` days and the ones before, and the change in percent."""
    last = rows.agg(F.max(day).alias("_last"))
    age = F.datediff("_last", day)
    sums = []
    for name, m in measures.items():
        sums += [F.sum(F.when(age < days, m)).alias(f"c_{name}"), F.sum(F.when((age >= days) & (age < 2 * days), m)).alias(f"p_{name}")]
    wide = rows.join(F.broadcast(last)).agg(*sums)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"c_{n}").cast("double").alias("current"), F.col(f"p_{n}").cast("double").alias("previous")) for n in measures])).alias("x")).select("x.*")
    return long.withColumn("change", F.when(F.coalesce("previous", F.lit(0.0)) == 0, 0.0).otherwise((F.col("current") - F.col("previous")) / F.col("previous") * 100))


def min_max(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """rows with `scaled` in 0..1 within their keys; a flat series is 0. Extremes by partial aggregation, joined back."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = rows.join(ends, list(keys))
    return out.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def nice_max(v: Column) -> Column:
    p = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = v / p
    return F.when(v <= 0, 1.0).otherwise(F.when(m <= 1, 1).when(m <= 2, 2).when(m <= 5, 5).otherwise(10) * p)


def neighbours(rows: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """rows with the four points of a smooth segment: before, own, next and the one after; the ends repeat themselves."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = F.coalesce(F.lead(value).over(w), F.col(value))
    return rows.withColumns({"p0": F.coalesce(F.lag(value).over(w), F.col(value)), "p2": nxt, "p3": F.coalesce(F.lead(value, 2).over(w), nxt)})


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
