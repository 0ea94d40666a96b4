"""Event-time aggregations that run the same over tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import delete, exists


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late and events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str | None = "1 hour") -> DataFrame:
    """start, event_type, n, value by windows of `width`; over a stream closed once the watermark has passed."""
    return sliding(events, width, width, late)


def sliding(events: DataFrame, width: str, step: str, late: str | None = "1 hour") -> DataFrame:
    w = F.window("ts", width, step)
    out = _watermarked(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """user_id, start, stop, n: runs of a user's events with less than `gap` between them."""
    out = _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per event_id; over a stream duplicates are told within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def limited_stream(calls: DataFrame, window: int, limit: int) -> DataFrame:
    """The rate limiter over a stream of (user_id, s, event_id): its state per key is the window's opening and its count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing for a whole window: a later call would open a new one anyway
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["s", "event_id"])
        flags = []
        for s in rows["s"]:
            if opened is None or s - opened >= window:
                opened, n = int(s), 1
                flags.append(False)
            else:
                flags.append(n >= limit)
                n += n < limit
        state.update((opened, n))
        state.setTimeoutDuration(1000 * window)
        yield rows.assign(limited=flags)[["user_id", "s", "event_id", "limited"]]

    return calls.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, s bigint, event_id bigint, limited boolean", "opened bigint, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of event files."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


#: Parts of the verdict table by the hash of a verdict's key; a batch of writes rewrites only the parts that it touches.
BUCKETS = 256
_VERDICTS = "hash string, rung string, hits bigint, updated_at timestamp"


def _versions(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """The version that each bucket has after a batch: at most one entry a bucket."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v={epoch}").collect()} if epoch >= 0 else {}


def _parts(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    found = [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(_VERDICTS).parquet(*found) if found else spark.createDataFrame([], _VERDICTS)


def read_verdicts(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """The verdict table as it is after a batch, which is one of the last two."""
    return _parts(spark, path, _versions(spark, path, epoch))


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keeps a verdict table (hash, rung, hits, updated_at) up to date from a stream of writes (hash, rung, ts).

    The table is cut into buckets by hash. A batch reads and writes the buckets that its rows fall into, then a manifest with the
    version of every bucket, which makes it visible at once. It starts from the manifest of the batch before, so one that is
    repeated after a failure gives the same table. What only older manifests name is deleted; a null hash is a key like others.
    """
    from ..operators.cache import upsert

    bucket = F.pmod(F.crc32(F.coalesce("hash", F.lit(""))), F.lit(buckets)).cast("int").alias("bucket")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, path, epoch - 1)
        touched = {r["bucket"] for r in batch.select(bucket).distinct().collect()}
        old = _parts(spark, path, {b: v for b, v in before.items() if b in touched})
        upsert(old, batch).select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={epoch}")
        after = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(after.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={epoch}")
        if epoch >= 2 and exists(spark, f"{path}/manifest/v={epoch - 2}"):
            older = _versions(spark, path, epoch - 2)
            for b in older:
                if older[b] != before[b]:
                    delete(spark, f"{path}/data/v={older[b]}/bucket={b}")
            delete(spark, f"{path}/manifest/v={epoch - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
