"""Jump consistent hashing of documents into shards, with gapless slots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, materialise

#: Parts of a shard that get their slots in tasks of their own.
PARTS = 1024
#: Draws are the first 13 hex digits (52 bits) of an md5.
_DRAWS = float(2**52)


def _draw(key: Column, i: Column) -> Column:
    """The i-th uniform number in (0, 1] of the generator seeded by key."""
    digits = F.substring(F.md5(F.concat_ws(":", key, i.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1) / _DRAWS


def jump_shard(key: Column, shards: int) -> Column:
    """The shard in 0..shards-1 by jump consistent hashing of a string key.

    Each step jumps from bucket b to floor((b + 1) / r) for the next uniform r of the key's generator; the last bucket
    below `shards` is the answer, so that one more shard takes its share of keys and moves no others.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, i: Column) -> Column:
        target = F.least(F.floor((s["j"] + 1) / _draw(key, i)), F.lit(2**31).cast("bigint"))
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), target.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["b"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard (with shards + 1).

    size is the text's UTF-8 bytes plus 1 and text_crc32 its unsigned crc32; a null or empty text has size 1 and crc 0.
    A null doc_id is the key "null". Rows with equal ids (repeated rows too) go to one shard and get slots of their own.
    An empty table gives no rows; other columns are not read.

    Slots run from 0 without gaps within each shard: rows are dealt by shard and one of `parts` hash parts (a fixed number of
    groups, none a whole shard), numbered there by doc_id, and moved by the counts of the parts before (shards * parts rows).
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), key.alias("_key"))
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        jump_shard(F.col("_key"), shards).alias("shard"),
        jump_shard(F.col("_key"), shards + 1).alias("grown_shard"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.col("text_crc32")).otherwise(id_crc(F.col("doc_id"))), F.lit(parts)).cast("int").alias("_part"),
    )
    rows = materialise(rows, "shards")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_row", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["shard", "_part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_row") + F.col("_before")).cast("bigint").alias("slot"), "grown_shard")
