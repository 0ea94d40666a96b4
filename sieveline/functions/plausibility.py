"""Arithmetic of promised returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the bands in percent a year, periods a year, and the ceiling.
STRETCH, IMPLAUSIBLE, IMPOSSIBLE = 15.0, 30.0, 200.0
PERIODS = {"day": 365, "week": 52, "month": 12, "year": 1, "unknown": 1}
CEILING = 1e9
POPULATION = 1.45e9


def annualise(percent: Column, period: Column) -> Column:
    """Compounded percent a year, 0 for rates that are not positive, at most the ceiling."""
    n = F.lit(float(PERIODS["unknown"]))
    for name, k in PERIODS.items():
        n = F.when(period == name, float(k)).otherwise(n)
    return F.when(percent > 0, F.least((F.pow(1 + percent / 100, n) - 1) * 100, F.lit(CEILING))).otherwise(0.0)


def band(annual: Column) -> Column:
    return F.when(annual > IMPOSSIBLE, "impossible").when(annual > IMPLAUSIBLE, "implausible").when(annual > STRETCH, "stretch").otherwise("plausible")


def doubling_years(annual: Column) -> Column:
    return F.when(annual > 0, F.log(F.lit(2.0)) / F.log(1 + annual / 100)).otherwise(float("inf"))


def recruitment(monthly: Column, start: Column, months: int) -> Column:
    """Recruits needed in each month so that new deposits pay the promised rate."""
    zero = F.struct(F.greatest(start.cast("double"), F.lit(1.0)).alias("held"), F.array().cast("array<double>").alias("needs"))

    def month(s: Column, _: Column) -> Column:
        need = F.ceil(s["held"] * (monthly / 100)).cast("double")
        return F.struct((s["held"] + need).alias("held"), F.concat(s["needs"], F.array(need)).alias("needs"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(months)), zero, month, lambda s: s["needs"])


def collapse_month(monthly: Column, start: float = 100.0, limit: float = POPULATION) -> Column:
    """First month of 1200 whose compounded number of depositors exceeds the limit, else null."""
    steps = F.ceil(F.log(F.lit(limit / max(1.0, start))) / F.log1p(F.when(monthly > 0, monthly / 100).otherwise(1.0)))
    exact = F.when(F.lit(max(1.0, start)) * F.pow(1 + monthly / 100, steps) > limit, steps).otherwise(steps + 1)
    return F.when((monthly > 0) & (exact <= 1200), exact.cast("bigint"))


def month_equivalent(annual: Column) -> Column:
    return (F.pow(1 + annual / 100, F.lit(1 / 12)) - 1) * 100
