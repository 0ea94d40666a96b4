"""Check records: series, sorted and filtered pages, exports, charts and command results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.dimensions import RUNGS
from .dashboard import mulberry32

# The seeded series' start, its last day and length, and the views there are.
SEED, LEVEL, LAST_DAY, DAYS = 1930, 2600.0, "2026-10-03", 90
VIEWS = ("overview", "checker", "lens", "voice", "engine", "registry", "privacy")
PER_PAGE, COMMANDS, LONG_QUERY, SHOWN = 8, 9, 12, 40


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5).cast("bigint")


def network_series(spark: SparkSession, days: int = DAYS) -> DataFrame:
    """day, checks, scams, cache_hits, tier1: the last days of the seeded demo series.

    Every day draws four numbers of the generator, so each one's place is known and no state is passed on; the level is a
    running product of the daily changes (a window over DAYS rows).
    """
    rows = spark.range(DAYS).select(F.col("id"), F.date_sub(F.lit(LAST_DAY).cast("date"), (DAYS - 1 - F.col("id")).cast("int")).alias("day"))
    draw = lambda k: mulberry32(SEED, F.col("id") * 4 + k)
    running = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", LEVEL * F.exp(F.sum(F.log(1 + (draw(1) - 0.42) * 0.06)).over(running)))
    viral = draw(2) > 0.94
    rows = rows.withColumn("checks", half_up(F.col("level") * F.when(F.dayofweek("day").isin(1, 7), 1.18).otherwise(1.0) * F.when(viral, 1.6).otherwise(1.0)))
    hits = half_up(F.col("checks") * (0.52 + draw(4) * 0.12) * F.when(viral, 1.2).otherwise(1.0))
    out = rows.select("day", "checks", half_up(F.col("checks") * (0.27 + draw(3) * 0.09) * F.when(viral, 1.25).otherwise(1.0)).alias("scams"), F.least(hits, F.col("checks")).alias("cache_hits"), half_up((F.col("checks") - hits) * 0.71).alias("tier1"))
    return out.where(F.col("day") > F.date_sub(F.lit(LAST_DAY).cast("date"), days))


def all_records(local: DataFrame, demo: DataFrame) -> DataFrame:
    """Both as one bag, with `local`."""
    return local.withColumn("local", F.lit(True)).unionByName(demo.withColumn("local", F.lit(False)))


def rung_rank(rung: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, _, step in RUNGS:
        out = F.when(rung == name, step).otherwise(out)
    return out


def page_of(records: DataFrame, sort: str, descending: bool = True, page: int = 0, only: str = "all", tie: str = "id") -> DataFrame:
    """A page of PER_PAGE records by ts, score or rung (its rank), risky or local ones only if asked for, with `pages` in all. A report."""
    if only == "risky":
        records = records.where(rung_rank(F.col("rung")) >= 2)
    elif only == "mine":
        records = records.where("local")
    key = rung_rank(F.col("rung")) if sort == "rung" else F.col(sort)
    count = records.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PER_PAGE)).cast("bigint").alias("pages"))
    view = records.orderBy(key.desc() if descending else key.asc(), tie).offset(page * PER_PAGE).limit(PER_PAGE)
    return view.join(F.broadcast(count))


CSV_HEADER = "time,hash,verdict,score,families,lang,channel,tier,ms,source"


def csv_rows(records: DataFrame) -> DataFrame:
    """line: the records as unquoted lines under CSV_HEADER; times in UTC to the millisecond, hashes cut to 16 characters."""
    columns = (
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.substring("hash", 1, 16), F.col("rung"), F.format_string("%.1f", F.col("score").cast("double")), F.array_join("families", "|"),
        F.col("lang"), F.col("channel"), F.col("tier"), F.col("ms").cast("string"), F.when(F.col("local"), "this-device").otherwise("network-sample"),
    )
    return records.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in columns]).alias("line"))


def donut(parts: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """parts with `share` of the total of their keys and `offset`, the shares before them in order; a total of 0 counts as 1."""
    own = Window.partitionBy(*keys)
    total = F.when(F.sum(value).over(own) == 0, F.lit(1.0)).otherwise(F.sum(value).over(own))
    rows = parts.withColumn("share", F.col(value) / total)
    return rows.withColumn("offset", F.coalesce(F.sum("share").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def control_points(points: DataFrame, order: str, x: str, y: str, *keys: str) -> DataFrame:
    """keys, order, c1x, c1y, c2x, c2y, to_x, to_y: the curve from each point to the next, through a sixth of its neighbours' difference."""
    w = Window.partitionBy(*keys).orderBy(order)
    p1, p2 = (lambda c: F.col(c)), (lambda c: F.lead(c).over(w))
    p0, p3 = (lambda c: F.coalesce(F.lag(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w)))
    out = [(p1(c) + (p2(c) - p0(c)) / 6).alias(f"c1{n}") for n, c in (("x", x), ("y", y))] + [(p2(c) - (p3(c) - p1(c)) / 6).alias(f"c2{n}") for n, c in (("x", x), ("y", y))]
    return points.select(*keys, order, *out, p2(x).alias("to_x"), p2(y).alias("to_y")).where("to_x is not null")


def compounded(rows: DataFrame, order: str, change: str, start: float, *keys: str) -> DataFrame:
    """rows with `level`: start times the product of 1 + change over the rows so far; a change of -1 or less ends it at 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.when(F.col(change) <= -1, 1).otherwise(0)).over(w)
    product = F.exp(F.sum(F.log(F.greatest(1 + F.col(change), F.lit(1e-300)))).over(w))
    return rows.withColumn("level", F.when(lost == 1, 0.0).otherwise(start * product))


def check_summary(tier0_ms: Column, tier1_ms: Column, shared: Column) -> Column:
    """struct(ms, tier): the rounded sum of both times, and "cache" for shared verdicts, else the tiers that ran."""
    tier = F.when(shared, "cache").when(tier1_ms.isNotNull(), "T0+T1").otherwise("T0")
    return F.struct(half_up(tier0_ms + F.coalesce(tier1_ms, F.lit(0.0))).alias("ms"), tier.alias("tier"))


def command_results(views: DataFrame, concepts: DataFrame, query: str) -> DataFrame:
    """seq, label, hint: for a long query the check first, then views (label, ord) and concepts (title, ord, keys) that hold it; COMMANDS at most. A report."""
    q = query.strip().lower()
    go = views.where(F.contains(F.lower("label"), F.lit(q))).select(F.lit(1).alias("kind"), "ord", "label", F.lit("Go to").alias("hint"))
    held = F.contains(F.lower("title"), F.lit(q)) | F.exists("keys", lambda k: F.contains(k, F.lit(q)))
    out = go.unionByName(concepts.where(held if q else F.lit(False)).select(F.lit(2).alias("kind"), "ord", F.col("title").alias("label"), F.lit("Concept").alias("hint")))
    if len(q) > LONG_QUERY:
        label = f"Check “{query[:SHOWN]}{'…' if len(query) > SHOWN else ''}”"
        out = out.unionByName(views.sparkSession.createDataFrame([(0, 0, label, "Run Tier-0")], "kind int, ord int, label string, hint string"))
    ranked = out.orderBy("kind", "ord").limit(COMMANDS)
    return ranked.withColumn("seq", F.row_number().over(Window.orderBy("kind", "ord"))).select("seq", "label", "hint")


def is_view(name: Column) -> Column:
    return F.coalesce(name.isin(*VIEWS), F.lit(False))
