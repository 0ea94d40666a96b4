"""Verdict cache and history tables: lookup, upsert, eviction, validation, rate limits (batch forms)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dimensions import RUNGS

# Sizes of the histories and the write limit.
HISTORY, LOCAL_VERDICTS, MEMORY = 200, 500, 5000
WINDOW_SECONDS, MAX_PER_WINDOW = 60, 20


def upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """hash, rung, hits, updated_at: writes merged into the cache; the last write's rung, one hit each. Partial sums, no window."""
    both = cache.select("hash", "rung", "hits", "updated_at").unionByName(writes.select("hash", "rung", F.lit(1).cast("bigint").alias("hits"), F.col("ts").alias("updated_at")))
    return both.groupBy("hash").agg(F.max_by("rung", F.struct("updated_at", "rung")).alias("rung"), F.sum("hits").alias("hits"), F.max("updated_at").alias("updated_at"))


def lookup(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """messages with the cached verdict, null on a miss."""
    return messages.join(cache, "hash", "left")


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows by an order: a report of bounded size (top-n per task, then of those)."""
    return rows.orderBy(*order).limit(n)


def latest_per_key(rows: DataFrame, key: str, ts: str, *columns: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(F.struct(ts, *columns)).alias("_l")).select(key, f"_l.{ts}", *[f"_l.{c}" for c in columns])


def fifo_replay(puts: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """key, first: the keys that a bounded map holds after all puts in order, and the put that inserted each.

    A put that finds more than capacity keys first evicts the one inserted longest ago; a key that is held then keeps its place,
    and one that returns after its eviction is inserted anew. What is held depends on all puts before, so one task replays them;
    rows stream through it sorted, and its state is capacity + 1 keys.
    """
    kinds = {f.name: f.dataType for f in puts.schema}
    schema = f"`{key}` {kinds[key].simpleString()}, first {kinds[order].simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = {}, None
        for b in batches:
            types = b.schema.types
            for k, at in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                if len(held) > capacity:
                    del held[next(iter(held))]
                held.setdefault(k, at)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((held.keys(), held.values()), types, strict=True)], names=[key, "first"])

    return puts.select(key, order).repartition(1).sortWithinPartitions(order, key).mapInArrow(run, schema)


def payload_status(hash_: Column, simhash: Column, rung: Column, attempt: Column, limit: int = 30) -> Column:
    """HTTP-like status of a write: 400 bad hash, 429 over the limit, 422 bad payload, else 200."""
    names = [r for r, _, _ in RUNGS]
    ok = simhash.rlike("^[0-9a-f]{16}$") & rung.isin(*names)
    return F.when(~F.coalesce(hash_.rlike("^[0-9a-f]{64}$"), F.lit(False)), 400).when(attempt > limit, 429).when(F.coalesce(ok, F.lit(False)), 200).otherwise(422)


def valid_codes(codes: Column) -> Column:
    return F.slice(F.filter(codes, lambda c: c.rlike("^[A-Z0-9_]{2,40}$")), 1, 30)


def rate_limit(calls: DataFrame, key: str, seconds: str, order: str, window: int = WINDOW_SECONDS, limit: int = MAX_PER_WINDOW) -> DataFrame:
    """calls with `limited`: a window opens at a key's first call and lasts `window` seconds; calls beyond `limit` in it are limited.

    Sequential per key, so keys go to Python in groups of sorted rows; the state is two numbers, and rows stream through in
    batches, whatever a key's number of calls.
    """
    kinds = dict(calls.dtypes)
    schema = f"{', '.join(f'`{c}` {kinds[c]}' for c in (key, seconds, order))}, limited boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, n = object(), 0.0, 0
        for b in batches:
            out = []
            for k, s in zip(b[key], b[seconds], strict=True):
                if k != current or s - opened >= window:
                    current, opened, n = k, s, 1
                    out.append(False)
                elif n >= limit:
                    out.append(True)
                else:
                    n += 1
                    out.append(False)
            yield b.assign(limited=out)

    ordered = calls.select(key, seconds, order).repartition(key).sortWithinPartitions(key, seconds, order)
    return ordered.mapInPandas(run, schema)


def violations(rows: DataFrame, **checks: Column) -> DataFrame:
    """rule, n: rows that break each named condition (null counts as broken)."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return rows.select(F.explode(F.array_compact(broken)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def with_running(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))
