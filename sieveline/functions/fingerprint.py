"""Exact and similarity fingerprints."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_MASK = (1 << 32) - 1
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def utf16_units(text: Column) -> Column:
    """The UTF-16 units of a text as numbers: characters beyond the first plane are two."""

    def units(c: Column) -> Column:
        p = F.ascii(c).cast("bigint")
        return F.when(p > 0xFFFF, F.array(0xD800 + F.shiftright(p - 0x10000, 10), 0xDC00 + (p - 0x10000).bitwiseAND(F.lit(0x3FF)))).otherwise(F.array(p))

    return F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), units))


def fnv1a64_hex(text: Column) -> Column:
    """FNV-1a over UTF-16 units, 16 hex digits. The state is held in two halves of 32 bits, so nothing overflows.

    The prime is 2**40 + 435: high half = high * 435 + carry of low * 435 + low shifted by 8.
    """
    zero = F.struct(F.lit(_OFFSET >> 32).alias("hi"), F.lit(_OFFSET & _MASK).alias("lo"))

    def step(s: Column, c: Column) -> Column:
        lo = s["lo"].bitwiseXOR(c)
        product = lo * 435
        hi = (s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(_MASK))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(_MASK)).alias("lo"))

    return F.lower(F.aggregate(utf16_units(text), zero, step, lambda s: F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, as a number; the prime 2**24 + 403 in two products."""

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        return (x * 403 + F.shiftleft(x, 24)).bitwiseAND(F.lit(_MASK))

    return F.aggregate(utf16_units(text), F.lit(0x811C9DC5).cast("bigint"), step)


def _simhash(text: str | None) -> int | None:
    if text is None:
        return None
    units = np.frombuffer(re.sub(r"\s+", " ", text).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    if len(units) < 4:
        return 0
    h = np.full(len(units) - 3, _OFFSET, np.uint64)
    for i in range(4):
        h = (h ^ units[i : len(units) - 3 + i]) * np.uint64(_PRIME)
    bit = np.arange(64, dtype=np.uint64)
    ones = sum(((h[k : k + 4096, None] >> bit) & np.uint64(1)).sum(axis=0) for k in range(0, len(h), 4096))
    bits = 0
    for b in np.flatnonzero(2 * ones.astype(np.int64) > len(h)):
        bits |= 1 << int(b)
    return bits - (1 << 64) if bits >> 63 else bits


@F.pandas_udf(LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """SimHash of all four-character shingles of normalised text, as a signed long; 0 below four characters."""
    return pd.Series([_simhash(t) for t in text], dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
