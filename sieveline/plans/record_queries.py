"""Queries over check records, requests, streams and devices, each with its SQL. Events, parts and conversations stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..sources import dimensions as dim
from ..sources import requests
from .event_queries import _DAYS, _IMUL, _RUNG_SQL, _events, _rung


def network_series(spark, d):
    return records.network_series(spark, 30)


_NETWORK = (
    "WITH s AS (SELECT i AS id, (1930::BIGINT + i * 1831565813) & 4294967295 AS s FROM range(1, 361) t(i)), "
    "a AS (SELECT id, " + _IMUL.format(a="xor(s, s >> 15)", b="s | 1") + " AS t FROM s), "
    "b AS (SELECT id, t, (t + (" + _IMUL.format(a="xor(t, t >> 7)", b="t | 61") + ")) & 4294967295 AS u FROM a), "
    "c AS (SELECT id, xor(u, t) AS t FROM b), r AS (SELECT id, xor(t, t >> 14) / 4294967296.0::DOUBLE AS x FROM c), "
    """w AS (SELECT (id - 1) // 4 AS i, max(CASE WHEN id % 4 = 1 THEN x END) AS a, max(CASE WHEN id % 4 = 2 THEN x END) AS b, max(CASE WHEN id % 4 = 3 THEN x END) AS c, max(CASE WHEN id % 4 = 0 THEN x END) AS d FROM r GROUP BY 1),
l AS (SELECT *, DATE '2026-10-03' - (89 - i)::INTEGER AS day, 2600.0::DOUBLE * exp(sum(ln(1 + (a - 0.42) * 0.06)) OVER (ORDER BY i)) AS level FROM w),
k AS (SELECT *, floor(level * CASE WHEN dayofweek(day) IN (0, 6) THEN 1.18 ELSE 1.0 END * CASE WHEN b > 0.94 THEN 1.6 ELSE 1.0 END + 0.5)::BIGINT AS checks FROM l),
h AS (SELECT *, floor(checks * (0.52 + d * 0.12) * CASE WHEN b > 0.94 THEN 1.2 ELSE 1.0 END + 0.5)::BIGINT AS hits FROM k)
SELECT day, checks, floor(checks * (0.27 + c * 0.09) * CASE WHEN b > 0.94 THEN 1.25 ELSE 1.0 END + 0.5)::BIGINT AS scams, least(hits, checks) AS cache_hits, floor((checks - hits) * 0.71 + 0.5)::BIGINT AS tier1 FROM h WHERE i >= 60"""
)


def _records(spark, d):
    e = _events(spark, d)
    rows = e.select(
        F.col("event_id").alias("id"), "ts", F.sha2(F.col("user_id").cast("string"), 256).alias("hash"), _rung().alias("rung"), (F.pmod("event_id", F.lit(100)) / 10).alias("score"),
        F.array(F.lit("urgency"), F.col("event_type")).alias("families"), F.lit("en").alias("lang"), F.lit("paste").alias("channel"), F.lit("T0").alias("tier"), F.pmod("event_id", F.lit(50)).alias("ms"),
    )
    return records.all_records(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"))


def records_page(spark, d):
    columns = ["id", "rung", "score", "local", "pages"]
    a = records.page_of(_records(spark, d), "rung", True, 1, "risky").select(F.lit("rung").alias("sort"), *columns)
    b = records.page_of(_records(spark, d), "score", False, 2, "mine").select(F.lit("score").alias("sort"), *columns)
    return a.unionByName(b).unionByName(records.page_of(_records(spark, d), "ts").select(F.lit("ts").alias("sort"), *columns))


_R = f"r AS (SELECT event_id AS id, ts, {_RUNG_SQL} AS rung, event_id % 5 AS step, (event_id % 100) / 10.0::DOUBLE AS score, event_id % 3 = 0 AS local, event_type, user_id FROM events)"
_PAGE = f"""WITH {_R}, p AS (SELECT (SELECT greatest(1, ceil(count(*) / 8.0))::BIGINT FROM r) AS a, (SELECT greatest(1, ceil(count(*) / 8.0))::BIGINT FROM r WHERE step >= 2) AS b, (SELECT greatest(1, ceil(count(*) / 8.0))::BIGINT FROM r WHERE local) AS c)
(SELECT 'rung' AS sort, id, rung, score, local, b AS pages FROM r, p WHERE step >= 2 ORDER BY step DESC, id LIMIT 8 OFFSET 8)
UNION ALL (SELECT 'score', id, rung, score, local, c FROM r, p WHERE local ORDER BY score, id LIMIT 8 OFFSET 16) UNION ALL (SELECT 'ts', id, rung, score, local, a FROM r, p ORDER BY ts DESC, id LIMIT 8)"""


def csv_export(spark, d):
    return records.csv_rows(_records(spark, d))


_CSV = f"""WITH {_R} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ',' || left(sha256(user_id::VARCHAR), 16) || ',' || rung || ',' || printf('%.1f', score) || ',urgency|' || event_type || ',en,paste,T0,' || id % 50 || ',' || CASE WHEN local THEN 'this-device' ELSE 'network-sample' END AS line FROM r"""


def donut_shares(spark, d):
    parts = _events(spark, d).groupBy("event_type", F.dayofweek("ts").alias("dow")).agg(F.count(F.lit(1)).alias("n"))
    return records.donut(parts, "event_type", "n", "dow").select("event_type", "dow", F.round("share", 8).alias("share"), F.round("offset", 8).alias("offset"))


_DONUT = """WITH p AS (SELECT event_type, dayofweek(ts) + 1 AS dow, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, dow::INTEGER AS dow, round(n / sum(n) OVER (PARTITION BY dow), 8) AS share, round(coalesce(sum(n) OVER (PARTITION BY dow ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY dow), 8) AS "offset" FROM p"""


def chart_curves(spark, d):
    rows = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.datediff("day", F.lit("2020-01-01").cast("date")))
    out = records.control_points(rows, "day", "x", "n", "event_type")
    return out.select("event_type", "day", *[F.round(c, 6).alias(c) for c in ("c1x", "c1y", "c2x", "c2y")], "to_x", "to_y")


_CURVES = f"""WITH p AS (SELECT *, date_diff('day', DATE '2020-01-01', day) AS x FROM {_DAYS}),
q AS (SELECT *, coalesce(lag(x) OVER w, x) AS x0, coalesce(lag(n) OVER w, n) AS n0, lead(x) OVER w AS x2, lead(n) OVER w AS n2, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS x3, coalesce(lead(n, 2) OVER w, lead(n) OVER w) AS n3 FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, round(x + (x2 - x0) / 6.0::DOUBLE, 6) AS c1x, round(n + (n2 - n0) / 6.0::DOUBLE, 6) AS c1y, round(x2 - (x3 - x) / 6.0::DOUBLE, 6) AS c2x, round(n2 - (n3 - n) / 6.0::DOUBLE, 6) AS c2y, x2::INTEGER AS to_x, n2 AS to_y FROM q WHERE x2 IS NOT NULL"""


def compounded_level(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", ((F.pmod("event_id", F.lit(11)) - 5) / 100).alias("change"))
    return records.compounded(rows, "event_id", "change", 100.0, "user_id").select("user_id", "event_id", F.round("level", 6).alias("level"))


def check_summaries(spark, d):
    e = _events(spark, d)
    s = records.check_summary(F.pmod("event_id", F.lit(9)) / 4, F.when(F.pmod("event_id", F.lit(2)) == 0, F.pmod("event_id", F.lit(7)) * 10.25), F.pmod("event_id", F.lit(5)) == 0)
    return e.select("event_id", s.alias("s")).groupBy("s.tier", "s.ms").agg(F.count(F.lit(1)).alias("n"))


def view_whitelist(spark, d):
    names = F.array(*map(F.lit, ("overview", "lens", "toString", "registry ", "Voice", "privacy")))
    rows = _events(spark, d).select(F.element_at(names, (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("view"))
    return rows.groupBy("view", records.is_view(F.col("view")).alias("known")).agg(F.count(F.lit(1)).alias("n"))


_COMMAND = "Guaranteed return"


def command_palette(spark, d):
    views = spark.createDataFrame([(v, i) for i, v in enumerate(records.VIEWS)], "label string, ord int")
    concepts = spark.createDataFrame([(c, i, list(ks)) for i, (c, _, ks) in enumerate(dim.CONCEPTS)], "title string, ord int, keys array<string>")
    long = records.command_results(views, concepts, _COMMAND).select(F.lit("long").alias("query"), "*")
    return long.unionByName(records.command_results(views, concepts, "re").select(F.lit("short").alias("query"), "*"))


_ITEMS = "(SELECT * FROM " + dim.sql_values([(1, i, v, "Go to", "") for i, v in enumerate(records.VIEWS)] + [(2, i, c, "Concept", "~".join(ks)) for i, (c, _, ks) in enumerate(dim.CONCEPTS)], "i(kind, ord, label, hint, keys)") + ")"
_PALETTE = f"""WITH c AS (SELECT 'long' AS query, 0 AS kind, 0 AS ord, 'Check “{_COMMAND}”' AS label, 'Run Tier-0' AS hint
  UNION ALL SELECT q.query, kind, ord, label, hint FROM {_ITEMS}, (VALUES ('long', '{_COMMAND.lower()}'), ('short', 're')) q(query, s) WHERE contains(lower(label), s) OR len(list_filter(string_split(keys, '~'), lambda k: contains(k, s))) > 0)
SELECT query, r::INTEGER AS seq, label, hint FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY kind, ord) AS r FROM c) WHERE r <= 9"""


def request_fields(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)).alias("k"))
    kind = F.when(F.col("k") == 0, "application/json; charset=utf-8").when(F.col("k") == 1, "application/x-www-form-urlencoded").otherwise("text/plain")
    body = F.when(F.col("k") == 0, F.concat(F.lit('{"text":"hi '), F.col("turn").cast("string"), F.lit('","Digits":'), F.col("conv_id").cast("string"), F.lit(',"other":"x"}')))
    body = body.when(F.col("k") == 1, F.concat(F.lit("From=%2B91"), F.col("conv_id").cast("string"), F.lit("&SpeechResult=a+b%20c&From="), F.col("role"))).otherwise(F.concat(F.col("role"), F.lit(" says")))
    return c.select("conv_id", "turn", F.explode(requests.read_inputs(kind, body)).alias("field", "value"))


_REQUESTS = """WITH c AS (SELECT conv_id, turn, role, (conv_id + turn) % 3 AS k FROM conversations)
SELECT conv_id, turn, 'text' AS field, 'hi ' || turn AS value FROM c WHERE k = 0 UNION ALL SELECT conv_id, turn, 'Digits', conv_id::VARCHAR FROM c WHERE k = 0
UNION ALL SELECT conv_id, turn, 'From', role FROM c WHERE k = 1 UNION ALL SELECT conv_id, turn, 'SpeechResult', 'a b c' FROM c WHERE k = 1 UNION ALL SELECT conv_id, turn, 'text', role || ' says' FROM c WHERE k = 2"""


def stream_tokens(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    content = F.when(F.pmod("turn", F.lit(5)) == 4, "[DONE]").otherwise(F.concat(F.lit('{"choices":[{"delta":{"content":"'), F.col("turn").cast("string"), F.lit("-"), F.col("role"), F.lit('"}}]}')))
    raw = F.concat(F.when(F.col("role") == "system", ": ").otherwise("data: "), content, F.lit("\n"))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.substring(raw, 1, 9).alias("chunk")), F.struct(F.lit(1).alias("part"), F.substring(raw, 10, 12).alias("chunk")), F.struct(F.lit(2).alias("part"), F.substring(raw, 22, 999).alias("chunk")))
    chunks = c.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", (F.col("turn") * 3 + F.col("p.part")).alias("seq"), "p.chunk").where("chunk <> ''")
    return requests.stream_tokens(chunks, "conv_id").select("conv_id", "token")


_TOKENS = "SELECT conv_id, turn || '-' || role AS token FROM conversations WHERE role <> 'system' AND turn % 5 <> 4"


def provider_fallback(spark, d):
    a = _events(spark, d).select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("provider"), F.when(F.pmod("event_id", F.lit(16)) == 0, 200).when(F.pmod("event_id", F.lit(4)) == 1, 429).otherwise(500).alias("status"), F.concat(F.lit("body "), F.col("event_id").cast("string")).alias("body"))
    return requests.first_answer(a, "user_id", F.lit("fixed"))


_PROVIDER = """SELECT user_id, coalesce(min_by('body ' || event_id, event_id) FILTER (WHERE event_id % 16 = 0), 'fixed') AS answer, coalesce(min_by(event_type, event_id) FILTER (WHERE event_id % 16 = 0), 'deterministic-fallback') AS source
FROM events GROUP BY user_id"""


def resolved_bases(spark, d):
    bases = ("", "  ", "/models/v{n}//", "models/v{n}", "https://cdn.example/v{n}/", "HTTP://x.example", "blob:abc/{n}")
    p = spark.read.parquet(f"{d}/part.parquet")
    base = F.replace(F.element_at(F.array(*map(F.lit, bases)), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int")), F.lit("{n}"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", requests.resolve_base(base, F.lit("https://app.example/page?x=1")).alias("url"))


_BASES = """SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN 'https://app.example/models/v' || p_partkey WHEN 3 THEN 'https://app.example/models/v' || p_partkey WHEN 4 THEN 'https://cdn.example/v' || p_partkey WHEN 5 THEN 'HTTP://x.example' WHEN 6 THEN 'blob:abc/' || p_partkey ELSE '' END AS url FROM part"""


def device_profiles(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey")
    memory, threads = F.when(F.pmod(key, F.lit(11)) > 0, F.pmod(key, F.lit(11)).cast("double")), (F.pmod(key, F.lit(9)) + 1).cast("int")
    device = requests.device_profile(memory, threads, F.pmod(key, F.lit(2)) == 0, F.pmod(key, F.lit(3)) == 0)
    reason = requests.defer_reason(F.pmod(key, F.lit(5)) == 0, F.element_at(F.array(*map(F.lit, ("4g", "slow-2g", "2g"))), (F.pmod(key, F.lit(3)) + 1).cast("int")))
    return p.select(device.alias("x"), reason.alias("deferred")).groupBy("x.profile", "x.backend", "x.budget", "x.threads", "deferred").agg(F.count(F.lit(1)).alias("n"))


_DEVICES = """WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 11 ELSE 4 END AS m, p_partkey % 9 + 1 AS t FROM part),
b AS (SELECT *, CASE WHEN m >= 8 AND t >= 8 THEN 'flagship' WHEN m <= 2 OR t <= 2 THEN 'minimal' WHEN m <= 3 OR t <= 4 THEN 'low' ELSE 'mid' END AS profile FROM a),
c AS (SELECT *, CASE WHEN profile = 'minimal' AND m < 2 THEN 'tier0-only' WHEN k % 2 = 0 AND profile <> 'minimal' THEN 'webgpu' WHEN k % 3 = 0 AND t > 2 THEN 'wasm-mt' ELSE 'wasm-st' END AS backend FROM b)
SELECT profile, backend, CASE profile WHEN 'low' THEN 1 WHEN 'minimal' THEN 0 ELSE 3 END AS budget, CASE WHEN backend = 'wasm-mt' THEN greatest(1, least(4, t - 1)) ELSE 1 END::INTEGER AS threads,
  CASE WHEN k % 5 = 0 THEN 'Data Saver is on' WHEN k % 3 = 1 THEN 'connection is slow-2g' WHEN k % 3 = 2 THEN 'connection is 2g' END AS deferred, count(*) AS n FROM c GROUP BY ALL"""

_LANGS = ("en-IN", "hi-IN", "ta-IN", "en-GB")


def voice_choice(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    voices = s.select(F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, ("en-in", "EN-US", "ta-LK", "hi-IN"))), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")).alias("lang"), (F.pmod("s_suppkey", F.lit(3)) == 0).alias("local"), F.col("s_suppkey").alias("ord"))
    wanted = spark.createDataFrame([(x, x) for x in (*_LANGS, "bn-IN")], "want string, lang string")
    return requests.voices_for(wanted, voices, "want")


_VOICES = f"""WITH v AS (SELECT s_name AS name, lower(['en-in', 'EN-US', 'ta-LK', 'hi-IN'][s_suppkey % 4 + 1]) AS lang, s_suppkey % 3 = 0 AS local, s_suppkey AS ord FROM supplier),
b AS (SELECT want, name, local, ord, lang = lower(want) AS exact, max((lang = lower(want))::INTEGER) OVER (PARTITION BY want) AS any_exact FROM v, (SELECT unnest({list(_LANGS)}) AS want) WHERE split_part(lang, '-', 1) = lower(split_part(want, '-', 1)))
SELECT want, name, row_number() OVER (PARTITION BY want ORDER BY CASE WHEN any_exact = 1 THEN (NOT local)::INTEGER ELSE 0 END, ord)::INTEGER AS rank FROM b WHERE any_exact = 0 OR exact"""


def model_states(spark, d):
    names = {"signup": "probe", "view": "download", "purchase": "loaded", "error": "fail"}
    event = F.lit("heartbeat")
    for k, v in names.items():
        event = F.when(F.col("event_type") == k, v).otherwise(event)
    rows = _events(spark, d).select("user_id", F.col("event_id").alias("seq"), event.alias("event"))
    return requests.model_states(rows, "user_id").groupBy("event", "state").agg(F.count(F.lit(1)).alias("n"))


_STATES = """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'probe' WHEN 'view' THEN 'download' WHEN 'purchase' THEN 'loaded' WHEN 'error' THEN 'fail' ELSE 'heartbeat' END AS event,
  CASE event_type WHEN 'signup' THEN 'probing' WHEN 'view' THEN 'downloading' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'error' END AS s FROM events)
SELECT event, state, count(*) AS n FROM (SELECT event, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'idle') AS state FROM e) GROUP BY 1, 2"""


QUERIES = {
    "network_series": (network_series, _NETWORK),
    "records_page": (records_page, _PAGE),
    "csv_export": (csv_export, _CSV),
    "donut_shares": (donut_shares, _DONUT),
    "chart_curves": (chart_curves, _CURVES),
    "compounded_level": (compounded_level, "SELECT user_id, event_id, round(100 * exp(sum(ln(1 + (event_id % 11 - 5) / 100.0::DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS level FROM events"),
    "check_summaries": (check_summaries, "SELECT CASE WHEN event_id % 5 = 0 THEN 'cache' WHEN event_id % 2 = 0 THEN 'T0+T1' ELSE 'T0' END AS tier, floor(event_id % 9 / 4.0::DOUBLE + CASE WHEN event_id % 2 = 0 THEN event_id % 7 * 10.25::DOUBLE ELSE 0 END + 0.5)::BIGINT AS ms, count(*) AS n FROM events GROUP BY 1, 2"),
    "view_whitelist": (view_whitelist, "SELECT v AS view, v IN ('overview', 'lens', 'privacy') AS known, count(*) AS n FROM (SELECT ['overview', 'lens', 'toString', 'registry ', 'Voice', 'privacy'][event_id % 6 + 1] AS v FROM events) GROUP BY v"),
    "command_palette": (command_palette, _PALETTE),
    "request_fields": (request_fields, _REQUESTS),
    "stream_tokens": (stream_tokens, _TOKENS),
    "provider_fallback": (provider_fallback, _PROVIDER),
    "resolved_bases": (resolved_bases, _BASES),
    "device_profiles": (device_profiles, _DEVICES),
    "voice_choice": (voice_choice, _VOICES),
    "model_states": (model_states, _STATES),
}
