"""Queries over questions, explanations, market paths and pair-merge encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market, questions, routing, tier0, tokenizer
from ..sources import dimensions as dim
from ..sources.messages import messages
from .event_queries import _DRAWS
from .message_queries import _EVIDENCE


def render_options(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("choice", "score", "noul"))), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    keys, texts = F.array(F.lit("false"), F.lit("true")), F.array(F.when(F.pmod("p_partkey", F.lit(2)) == 0, "").otherwise(F.col("p_brand")), F.col("p_type"))
    return p.select("p_partkey", F.posexplode(questions.render_options(kind, keys, texts)).alias("i", "option"))


_RENDER = f"""WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS a, p_type AS b FROM part)
SELECT p_partkey, i::INTEGER AS i, CASE k WHEN 0 THEN CASE WHEN i = 0 THEN CASE WHEN a = '' THEN 'false' ELSE 'false: ' || a END ELSE 'true: ' || b END
  WHEN 1 THEN 'level ' || i || ': ' || CASE WHEN i = 0 THEN a ELSE b END
  ELSE CASE WHEN i = 0 THEN 'false: ' || CASE WHEN a = '' THEN '{questions.NO}' ELSE a END ELSE 'true: ' || b END END AS option FROM p, range(0, 2) t(i)"""


def bank_validation(spark, d):
    return questions.bank_violations(questions.default_bank(spark))


def explain_fallback(spark, d):
    rows = tier0.tier0(messages(spark, d)).select("msg_id", F.posexplode("evidence").alias("seq", "e")).select("msg_id", "seq", "e.code")
    return questions.explain(rows, "msg_id")


_LABEL = "(SELECT * FROM " + dim.sql_values([(f, t, i) for i, (f, t) in enumerate(dim.FAMILY_LABELS.items())], "n(family, label, ord)") + ")"
_EXPLAIN = f"""WITH {_EVIDENCE} SELECT msg_id, coalesce(string_agg('- ' || label, chr(10) ORDER BY ord) || chr(10), '') || 'Report fraud: 1930.' AS text FROM evidence LEFT JOIN {_LABEL} ON lower(regexp_replace(code, '^LEX_', '')) = family GROUP BY msg_id"""


def spoken_lines(spark, d):
    rows = tier0.tier0(messages(spark, d)).select("msg_id", "rung", "lang")
    line = questions.spoken_line(F.col("rung"), F.col("lang"))
    return rows.groupBy("lang", questions.voice_response(line, F.col("lang")).alias("xml")).agg(F.count(F.lit(1)).alias("n"))


_MOOD = "CASE WHEN rung IN ('known_scam', 'likely_scam') THEN 'danger' WHEN rung = 'caution' THEN 'careful' WHEN rung = 'unclear' THEN 'unsure' ELSE 'calm' END"
_LINES = "(SELECT * FROM " + dim.sql_values([(c, m, x) for c, ms in questions.SPOKEN.items() for m, x in ms.items()], "l(code, mood, line)") + ")"
_SPOKEN = f"""WITH {_EVIDENCE}, r AS (SELECT lang, CASE WHEN lower(lang) LIKE 'hi%' THEN 'hi' ELSE 'en' END AS code, {_MOOD} AS mood FROM verdicts JOIN msg USING (msg_id))
SELECT lang, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Response><Say language="' || code || '-IN">' || line || '</Say><Hangup/></Response>' AS xml, count(*) AS n FROM r JOIN {_LINES} USING (code, mood) GROUP BY 1, 2"""


def market_paths(spark, d):
    return market.outcome(market.paths(spark, 7, 2), 2).select(F.round("hold", 4).alias("hold"), F.round("panic", 4).alias("panic"))


_STEPS, _CRASH = 2 * market.DAYS, int(2 * market.DAYS * 0.3)
_MARKET = f"""WITH {_DRAWS.format(seed=7, end=2 * market.PATHS * _STEPS + 1)},
z AS (SELECT u.id // 2 AS id, sqrt(-2 * ln(u.x + 1e-12)) * cos(2 * pi() * v.x) AS z FROM draws u JOIN draws v ON v.id = u.id + 1 WHERE u.id % 2 = 1),
m AS (SELECT id // {_STEPS} AS path, id % {_STEPS} AS i, {market.DRIFT / market.DAYS!r}::DOUBLE + {market.VOLATILITY / market.DAYS**0.5!r}::DOUBLE * z - CASE WHEN id % {_STEPS} BETWEEN {_CRASH} AND {_CRASH + market.SHOCK_DAYS - 1} THEN {market.SHOCK}::DOUBLE ELSE 0 END AS move FROM z),
p AS (SELECT path, i, 100 * exp(sum(move) OVER (PARTITION BY path ORDER BY i)) AS value FROM m),
e AS (SELECT path, max_by(value, i) AS final, min_by(value, i) FILTER (WHERE i > {_CRASH} AND value < {market.PANIC}) AS sold FROM p GROUP BY path)
SELECT round(avg(final), 4) AS hold, round(avg(coalesce(sold * {market.DEPOSIT ** ((_STEPS - _CRASH) / market.DAYS)!r}::DOUBLE, final)), 4) AS panic FROM e"""


def concept_fallback(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    names = ["guaranteed", "vip_tips", "nav", "exit_load", "basics", "risk", "sip"]
    key = F.element_at(F.array(*map(F.lit, names)), (F.pmod("event_id", F.lit(len(names))) + 1).cast("int"))
    return e.select(key.alias("key")).select("key", F.coalesce(routing.concept_for_bank_key(F.col("key")), routing.concept_for_family(F.col("key"))).alias("concept")).groupBy("key", "concept").agg(F.count(F.lit(1)).alias("n"))


_FALLBACK = "SELECT key, CASE key WHEN 'guaranteed' THEN 'guaranteed_return' WHEN 'vip_tips' THEN 'vip_group' WHEN 'nav' THEN 'nav' WHEN 'basics' THEN 'nav' WHEN 'risk' THEN 'diversification' WHEN 'sip' THEN 'sip' END AS concept, count(*) AS n FROM (SELECT ['guaranteed', 'vip_tips', 'nav', 'exit_load', 'basics', 'risk', 'sip'][event_id % 7 + 1] AS key FROM events) GROUP BY 1, 2"


def command_search(spark, d):
    return routing.search_concepts(dim.concept_keys(spark), "IP").select("concept", "keys")


def bpe_encode(spark, d):
    import public_tokenizers

    docs = spark.read.parquet(f"{d}/documents.parquet")
    return tokenizer.encode(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("digest"))


def stream_redaction(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("chunk"))
    return questions.redact_stream(c, "conv_id", "(?i)buy|sell|thththt").groupBy("redacted").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_REDACT = r"""WITH t AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY 1), h AS (SELECT t, regexp_extract(t, '(?is)^(.*?)(buy|sell|thththt)', 1) AS head, regexp_matches(t, '(?i)buy|sell|thththt') AS redacted FROM t)
SELECT redacted, count(*) AS n, sum(length(CASE WHEN redacted THEN head || '[removed]' ELSE t END))::BIGINT AS chars FROM h GROUP BY 1"""


QUERIES = {
    "render_options": (render_options, _RENDER),
    "bank_validation": (bank_validation, "SELECT * FROM (VALUES ('demo', 'fee', 'instructions'), ('demo', 'fee', 'triage_key'), ('demo', 'risk', 'options')) v(bank, qid, rule)"),
    "explain_fallback": (explain_fallback, _EXPLAIN),
    "spoken_lines": (spoken_lines, _SPOKEN),
    "market_paths": (market_paths, _MARKET),
    "concept_fallback": (concept_fallback, _FALLBACK),
    "command_search": (command_search, "SELECT concept, count(*) AS keys FROM " + "(SELECT * FROM " + dim.sql_values([(c, i, k) for i, (c, _, ks) in enumerate(dim.CONCEPTS) for k in ks], "c(concept, ord, key)") + ") WHERE contains(lower(concept), 'ip') OR contains(lower(key), 'ip') GROUP BY concept, ord ORDER BY ord LIMIT 9"),
    "bpe_encode": (bpe_encode, None),
    "stream_redaction": (stream_redaction, _REDACT),
}
