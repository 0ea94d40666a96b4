"""Pairs of fingerprints within a few bits."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import hamming


#: Blocks of a fingerprint that a pair must agree on to be compared.
AGREE = 3


def block_masks(bits: int) -> list[int]:
    """Masks over AGREE of bits + AGREE even blocks of 64 bits, for every choice of them, as signed longs."""
    n = bits + AGREE
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in itertools.combinations(blocks, AGREE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pairs_within(rows: DataFrame, key: str, fp: str, bits: int) -> DataFrame:
    """a, b, distance for a < b: fingerprints (longs) that differ in at most `bits` bits.

    Such bits touch at most `bits` blocks, so that two values agree on AGREE whole blocks at least (pigeonhole): only rows that
    are equal under one of the masks are compared. For 3 bits those are 20 masks of about 32 bits, so that chance meetings of n
    values are about 20 * n * n / 2 ** 33. Equal fingerprints are joined once, by their least key: a group of n copies gives
    n - 1 pairs with that key, not n * n.
    """
    groups = rows.groupBy(fp).agg(F.min(key).alias("a"))
    copies = rows.join(groups, fp).where(F.col(key) > F.col("a")).select("a", F.col(key).alias("b"), F.lit(0).alias("distance"))
    cut = F.array(*[F.struct(F.lit(i).alias("mask"), F.col(fp).bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(block_masks(bits))])
    masked = groups.select("a", F.col(fp).alias("fp"), F.explode(cut).alias("x")).select("a", "fp", "x.mask", "x.part")
    other = masked.select(F.col("a").alias("b"), F.col("fp").alias("fq"), "mask", "part")
    near = masked.join(other, ["mask", "part"]).where((F.col("a") < F.col("b")) & (hamming(F.col("fp"), F.col("fq")) <= bits))
    return near.select("a", "b", hamming(F.col("fp"), F.col("fq")).alias("distance")).distinct().unionAll(copies)
