"""Decoding of model logits: softmax, confidences, buckets, temperatures, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dimensions import ABSTAIN

# Order of question types, and bounds of fitted temperatures.
TYPES = ("choice", "score", "noul")
LOW_T, HIGH_T = 0.5, 5.0


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(logits, lambda x: x / t)
    exps = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def entropy_confidence(p: Column) -> Column:
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(1e-12))))
    return F.when(F.size(p) < 2, 1.0).otherwise(1 - h / F.log(F.size(p).cast("double")))


def max_confidence(p: Column) -> Column:
    return F.array_max(p)


def bucket(kind: Column, k: Column) -> Column:
    size = F.when(k <= 2, "2").when(k <= 5, "3-5").when(k <= 10, "6-10").otherwise("11+")
    return F.concat(kind, F.lit(":"), size)


def clamp_temperature(t: Column) -> Column:
    bad = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))
    return F.when(bad, 1.0).otherwise(F.greatest(F.lit(LOW_T), F.least(F.lit(HIGH_T), t)))


def temperature_for(by_bucket: Column, by_type: Column, kind: Column, k: Column) -> Column:
    """Exact bucket, then "default", then the type's, then 1; numbers that are not positive and finite count as 1."""
    position = F.when(kind == "choice", 1).when(kind == "score", 2).otherwise(3)
    t = F.coalesce(F.try_element_at(by_bucket, bucket(kind, k)), F.try_element_at(by_bucket, F.lit("default")), F.try_element_at(by_type, position), F.lit(1.0))
    return F.when((t > 0) & (t < float("inf")) & ~F.isnan(t), t).otherwise(1.0)


def abstain_for(cuts: Column, kind: Column, k: Column) -> Column:
    """The table's exact bucket, its "default", then the built-in bucket and default."""
    b = bucket(kind, k)
    built_in = F.lit(None).cast("double")
    for name, cut in ABSTAIN.items():
        built_in = F.when(b == name, cut).otherwise(built_in)
    return F.coalesce(F.try_element_at(cuts, b), F.try_element_at(cuts, F.lit("default")), built_in, F.lit(ABSTAIN["default"]))


def unpermute(p: Column, order: Column) -> Column:
    """Probabilities in the caller's order: out[order[slot]] = p[slot]; without an order as they are."""
    back = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.coalesce(F.try_element_at(p, F.nullif(F.array_position(order, i), F.lit(0)).cast("int")), F.lit(0.0)))
    return F.when(order.isNull(), p).otherwise(back)


def argmax(p: Column) -> Column:
    """Position from 0 of the first largest."""
    return F.array_position(p, F.array_max(p)) - 1


def expected_level(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, b: a + b)


def reward(p: Column, target: Column, ordinal: Column) -> Column:
    """Log score (at least -9.21) + half the spherical score - for ordinal questions the ranked probability score."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    dot = total(F.zip_with(p, target, lambda a, b: a * b))
    log_score = total(F.zip_with(p, target, lambda a, b: b * F.greatest(F.log(F.greatest(a, F.lit(1e-12))), F.lit(-9.21))))
    norm = F.sqrt(total(F.transform(p, lambda a: a * a)))
    gaps = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.pow(total(F.slice(p, F.lit(1), i)) - total(F.slice(target, F.lit(1), i)), F.lit(2.0)))
    ranked = total(gaps) / (F.greatest(F.size(p), F.lit(2)) - 1)
    return log_score + 0.5 * dot / F.greatest(norm, F.lit(1e-9)) - F.when(ordinal, ranked).otherwise(0.0)


def wilson_upper(errors: Column, n: Column, z: float = 1.28) -> Column:
    p = errors / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
