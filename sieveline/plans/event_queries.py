"""Queries over events: series, dashboard, cache and limits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cache, dashboard
from ..sources import dimensions as dim
from ..streaming import windows


def _events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _rung():
    return F.element_at(F.array(*[F.lit(r) for r, _, _ in dim.RUNGS]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))


_RUNG_SQL = "[" + ", ".join(f"'{r}'" for r, _, _ in dim.RUNGS) + "][event_id % 5 + 1]"


def daily_series(spark, d):
    day = F.to_date("ts")
    return _events(spark, d).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("event_type") == "error").alias("scams"), F.count_if(F.col("event_type") == "view").alias("cache_hits"), F.round(F.sum("value"), 4).alias("value"))


def kpi_period_over_period(spark, d):
    rows = _events(spark, d).select(F.to_date("ts").alias("day"), "event_type", "value")
    out = dashboard.period_change(rows, "day", 7, checks=F.lit(1), errors=F.when(F.col("event_type") == "error", 1).otherwise(0), value=F.col("value"))
    return out.select("measure", *[F.round(c, 4).alias(c) for c in ("current", "previous", "change")])


_KPI = """WITH e AS (SELECT ts::DATE AS day, event_type, value, (SELECT max(ts::DATE) FROM events) AS last FROM events),
a AS (SELECT *, date_diff('day', day, last) AS age FROM e),
m AS (SELECT measure, sum(CASE WHEN age < 7 THEN v END)::DOUBLE AS current, sum(CASE WHEN age >= 7 AND age < 14 THEN v END)::DOUBLE AS previous
  FROM (SELECT age, unnest(['checks', 'errors', 'value']) AS measure, unnest([1.0::DOUBLE, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, value]) AS v FROM a) GROUP BY measure)
SELECT measure, round(current, 4) AS current, round(previous, 4) AS previous, round(CASE WHEN coalesce(previous, 0) = 0 THEN 0 ELSE (current - previous) / previous * 100 END, 4) AS change FROM m"""


def family_share(spark, d):
    f = spark.createDataFrame(list(dim.FAMILY_SHARE.items()), "family string, count bigint")
    days = spark.createDataFrame([(7,), (30,), (90,)], "days int")
    return f.join(F.broadcast(days)).select("family", "days", F.round(F.col("count") * F.col("days") / 30).cast("bigint").alias("shown"))


def running_level(spark, d):
    rows = _events(spark, d).where("value is not null").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return cache.with_running(rows, "user_id", "day", "v").select("user_id", "day", F.round("running", 4).alias("running"))


def series_minmax(spark, d):
    rows = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return dashboard.min_max(rows, "n", "event_type").select("event_type", "day", F.round("scaled", 6).alias("scaled"))


def smooth_points(spark, d):
    rows = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return dashboard.neighbours(rows, "day", "n", "event_type").select("event_type", "day", "n", "p0", "p2", "p3")


_DAYS = "(SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def axis_max(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.max("value").alias("v")).select("event_type", dashboard.nice_max(F.col("v")).alias("axis"))


def prng_mulberry32(spark, d):
    return spark.range(1, 2001).select("id", dashboard.mulberry32(1930, F.col("id")).alias("x"))


_IMUL = "(({a} & 65535) * ({b}) + ((((({a}) >> 16) * (({b}) & 65535)) & 65535) << 16)) & 4294967295"
_DRAWS = (
    "s AS (SELECT i AS id, ({seed}::BIGINT + i * 1831565813) & 4294967295 AS s FROM range(1, {end}) t(i)), "
    "a AS (SELECT id, " + _IMUL.format(a="xor(s, s >> 15)", b="s | 1") + " AS t FROM s), "
    "b AS (SELECT id, t, (t + (" + _IMUL.format(a="xor(t, t >> 7)", b="t | 61") + ")) & 4294967295 AS u FROM a), "
    "c AS (SELECT id, xor(u, t) AS t FROM b), draws AS (SELECT id, xor(t, t >> 14) / 4294967296.0::DOUBLE AS x FROM c)"
)
_PRNG = f"WITH {_DRAWS.format(seed=1930, end=2001)} SELECT id, x FROM draws"


def recent_checks_page(spark, d):
    rows = _events(spark, d).withColumn("rung", _rung()).select("event_id", "ts", "rung")
    page = cache.newest(rows, 24, F.desc("ts"), F.col("event_id"))
    return page.orderBy(F.desc("ts"), "event_id").offset(8).limit(8)


def risky_filter(spark, d):
    rows = _events(spark, d).withColumn("rung", _rung()).join(F.broadcast(dim.rungs(spark)), "rung").where("step >= 2")
    return rows.groupBy("rung", "tone").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def csv_projection(spark, d):
    rows = _events(spark, d).withColumn("rung", _rung())
    line = dashboard.csv_line(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.left(F.sha2(F.col("event_id").cast("string"), 256), F.lit(16)), F.col("rung"), F.col("event_type"))
    return rows.select("event_id", line.alias("line"))


def retention_newest_n(spark, d):
    return cache.newest(_events(spark, d), cache.HISTORY, F.desc("ts"), F.desc("event_id")).select("event_id", "ts")


def dedupe_latest(spark, d):
    return cache.latest_per_key(_events(spark, d), "user_id", "ts", "event_id", "event_type")


def _writes(spark, d):
    e = _events(spark, d)
    return e.select(F.sha2(F.col("user_id").cast("string"), 256).alias("hash"), _rung().alias("rung"), "ts", "event_id")


def verdict_upsert(spark, d):
    w = _writes(spark, d)
    seed = w.where("event_id % 10 = 0").groupBy("hash").agg(F.max_by("rung", F.struct("ts", "rung")).alias("rung"), F.count(F.lit(1)).alias("hits"), F.max("ts").alias("updated_at"))
    return cache.upsert(seed, w.where("event_id % 10 <> 0"))


_W = f"(SELECT sha256(user_id::VARCHAR) AS hash, {_RUNG_SQL} AS rung, ts, event_id FROM events)"


def verdict_left_join(spark, d):
    known = verdict_upsert(spark, d).where("hits > 2").select("hash", F.col("rung").alias("cached"))
    return cache.lookup(_writes(spark, d), known).groupBy("cached").agg(F.count(F.lit(1)).alias("n"))


def payload_validation(spark, d):
    e = _events(spark, d)
    k = F.pmod("event_id", F.lit(7))
    h = F.when(k == 0, "xyz").otherwise(F.sha2(F.col("event_id").cast("string"), 256))
    s = F.when(k == 1, "short").otherwise(F.left(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(16)))
    r = F.when(k == 2, "other").otherwise(_rung())
    return e.select(cache.payload_status(h, s, r, F.pmod("event_id", F.lit(33))).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def schema_violations(spark, d):
    return cache.violations(_events(spark, d), value_positive=F.col("value") > 0, known_type=F.col("event_type").isin("signup", "purchase", "view", "click"), has_props=F.get_json_object("props", "$.k").isNotNull(), small_k=F.get_json_object("props", "$.k").cast("int") < 50)


def fixed_window_rate_limit(spark, d):
    calls = _events(spark, d).select("user_id", F.unix_timestamp("ts").alias("s"), "event_id")
    return cache.rate_limit(calls, "user_id", "s", "event_id", 86400, 2).select("event_id", "limited")


_LIMIT = """WITH RECURSIVE c AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS r FROM events),
w AS (
  SELECT user_id, event_id, r, s AS opened, 1 AS n, false AS limited FROM c WHERE r = 1
  UNION ALL
  SELECT c.user_id, c.event_id, c.r, CASE WHEN c.s - w.opened >= 86400 THEN c.s ELSE w.opened END, CASE WHEN c.s - w.opened >= 86400 THEN 1 WHEN w.n >= 2 THEN w.n ELSE w.n + 1 END, c.s - w.opened < 86400 AND w.n >= 2
  FROM w JOIN c ON c.user_id = w.user_id AND c.r = w.r + 1
) SELECT event_id, limited FROM w"""


def fifo_evict(spark, d):
    return cache.fifo_replay(_events(spark, d), "user_id", "event_id", 50)


def tumbling_counts(spark, d):
    return windows.tumbling(_events(spark, d), "6 hours")


def sliding_counts(spark, d):
    return windows.sliding(_events(spark, d), "2 days", "1 day")


def sessionize(spark, d):
    return windows.sessions(_events(spark, d), "12 hours")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k"""

_FIFO = """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (ORDER BY event_id) AS i FROM events),
r AS (SELECT 0::BIGINT AS i, []::STRUCT(u BIGINT, f BIGINT)[] AS h UNION ALL
  SELECT e.i, CASE WHEN list_contains(list_transform(t, lambda x: x.u), e.user_id) THEN t ELSE list_append(t, {'u': e.user_id, 'f': e.event_id}) END
  FROM (SELECT i, CASE WHEN len(h) > 50 THEN h[2:] ELSE h END AS t FROM r) q JOIN e ON e.i = q.i + 1)
SELECT x.u AS user_id, x.f AS first FROM (SELECT unnest(h) AS x FROM r WHERE i = (SELECT max(i) FROM e))"""


QUERIES = {
    "daily_series": (daily_series, "SELECT ts::DATE AS day, count(*) AS checks, count(CASE WHEN event_type = 'error' THEN 1 END) AS scams, count(CASE WHEN event_type = 'view' THEN 1 END) AS cache_hits, round(sum(value), 4) AS value FROM events GROUP BY 1"),
    "kpi_period_over_period": (kpi_period_over_period, _KPI),
    "family_share": (family_share, f"SELECT family, days, round(count * days / 30.0::DOUBLE)::BIGINT AS shown FROM {dim.sql_values(list(dim.FAMILY_SHARE.items()), 'f(family, count)')}, (VALUES (7), (30), (90)) d(days)"),
    "running_level": (running_level, "SELECT user_id, day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS running FROM (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"),
    "series_minmax": (series_minmax, f"SELECT event_type, day, round(CASE WHEN max(n) OVER w > min(n) OVER w THEN (n - min(n) OVER w)::DOUBLE / (max(n) OVER w - min(n) OVER w) ELSE 0 END, 6) AS scaled FROM {_DAYS} WINDOW w AS (PARTITION BY event_type)"),
    "smooth_points": (smooth_points, f"SELECT event_type, day, n, coalesce(lag(n) OVER w, n) AS p0, coalesce(lead(n) OVER w, n) AS p2, coalesce(lead(n, 2) OVER w, lead(n) OVER w, n) AS p3 FROM {_DAYS} WINDOW w AS (PARTITION BY event_type ORDER BY day)"),
    "axis_max": (axis_max, "SELECT event_type, CASE WHEN v <= 0 THEN 1 ELSE (CASE WHEN v / p <= 1 THEN 1 WHEN v / p <= 2 THEN 2 WHEN v / p <= 5 THEN 5 ELSE 10 END) * p END AS axis FROM (SELECT event_type, max(value) AS v, pow(10.0::DOUBLE, floor(log10(max(value)))) AS p FROM events GROUP BY 1)"),
    "prng_mulberry32": (prng_mulberry32, _PRNG),
    "recent_checks_page": (recent_checks_page, f"SELECT event_id, ts, {_RUNG_SQL} AS rung FROM events ORDER BY ts DESC, event_id LIMIT 8 OFFSET 8"),
    "risky_filter": (risky_filter, f"SELECT e.rung, tone, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT *, {_RUNG_SQL} AS rung FROM events) e JOIN (SELECT * FROM {dim.sql_values(dim.RUNGS, 'r(rung, tone, step)')}) r ON r.rung = e.rung WHERE step >= 2 GROUP BY 1, 2"),
    "csv_projection": (csv_projection, f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ',' || left(sha256(event_id::VARCHAR), 16) || ',' || {_RUNG_SQL} || ',' || event_type AS line FROM events"),
    "retention_newest_n": (retention_newest_n, "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200"),
    "dedupe_latest": (dedupe_latest, "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
    "verdict_upsert": (verdict_upsert, f"SELECT hash, rung, hits, updated_at FROM (SELECT hash, rung, ts AS updated_at, count(*) OVER (PARTITION BY hash) AS hits, row_number() OVER (PARTITION BY hash ORDER BY ts DESC, rung DESC) AS r FROM {_W}) WHERE r = 1"),
    "verdict_left_join": (verdict_left_join, f"SELECT cached, count(*) AS n FROM {_W} w LEFT JOIN (SELECT hash, rung AS cached FROM (SELECT hash, rung, count(*) OVER (PARTITION BY hash) AS hits, row_number() OVER (PARTITION BY hash ORDER BY ts DESC, rung DESC) AS r FROM {_W}) WHERE r = 1 AND hits > 2) k ON k.hash = w.hash GROUP BY 1"),
    "payload_validation": (payload_validation, "SELECT (CASE WHEN event_id % 7 = 0 THEN 400 WHEN event_id % 33 > 30 THEN 429 WHEN event_id % 7 IN (1, 2) THEN 422 ELSE 200 END)::INTEGER AS status, count(*) AS n FROM events GROUP BY 1"),
    "schema_violations": (schema_violations, "SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(value > 0, false) THEN 'value_positive' END, CASE WHEN event_type NOT IN ('signup', 'purchase', 'view', 'click') THEN 'known_type' END, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'has_props' END, CASE WHEN NOT coalesce(json_extract_string(props, '$.k')::INTEGER < 50, false) THEN 'small_k' END], lambda x: x IS NOT NULL)) AS rule FROM events) GROUP BY 1"),
    "fixed_window_rate_limit": (fixed_window_rate_limit, _LIMIT),
    "fifo_evict": (fifo_evict, _FIFO),
    "tumbling_counts": (tumbling_counts, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"),
    "sliding_counts": (sliding_counts, "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY * k AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, range(0, 2) t(k) GROUP BY 1, 2"),
    "sessionize": (sessionize, _SESSIONS),
}
