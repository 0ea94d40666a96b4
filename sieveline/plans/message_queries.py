"""Queries over made messages, pages and documents: normalisation, extraction, evidence and verdicts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, fingerprint, plausibility, text
from ..operators import fusion, near_pairs, routing, tier0
from ..sources import dimensions as dim
from ..sources.files import spread
from ..sources.messages import MESSAGES_SQL, messages


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return tier0.normalized(messages(spark, d))


_FROM, _TO = text.DIGITS + text.LOOKALIKES, text.DIGITS_TO + text.FOLDED_TO
_NORM = f"""msg AS ({MESSAGES_SQL}),
stripped AS (SELECT msg_id, regexp_replace(text, '{text.ZERO_WIDTH}', '', 'g') AS s, len(regexp_extract_all(text, '{text.ZERO_WIDTH}')) AS zw FROM msg),
norm AS (SELECT msg_id, trim(regexp_replace(lower(translate(s, '{_FROM}', '{_TO}')), '{text.SPACE}+', ' ', 'g')) AS norm,
  (zw + len(regexp_extract_all(s, '[{text.LOOKALIKES}]')))::INTEGER AS obfuscation FROM stripped)"""
_LEX = "(SELECT * FROM " + dim.sql_values([(f, t) for f, ts in dim.LEXICON.items() for t in ts], "l(family, term)") + ")"
_FAM = "(SELECT * FROM " + dim.sql_values(list(dim.FAMILY_WEIGHTS.items()), "f(family, weight)") + ")"
_PSP = "(" + ", ".join(f"'{h}'" for h in dim.PSP_HANDLES) + ")"
_MAIL = "(" + ", ".join(f"'{h}'" for h in dim.MAIL_HOSTS) + ")"
_REG = "(SELECT * FROM " + dim.sql_values(dim.REGISTRY, "r(reg, name, kind, status, valid_till)") + ")"

_UPI = rf"""upi AS (SELECT msg_id, id, handle, handle IN {_PSP} AS known FROM (
  SELECT msg_id, unnest(regexp_extract_all(norm, '\b{extract.UPI}\b', 0)) AS id, unnest(regexp_extract_all(norm, '\b{extract.UPI}\b', 2)) AS handle FROM norm) WHERE handle NOT IN {_MAIL})"""
_PHONES = rf"""phones AS (SELECT msg_id, trim(raw) AS raw, CASE WHEN regexp_matches(l, '^1600\d{{6}}$') THEN 'trai_1600' WHEN regexp_matches(l, '^1800\d{{6,7}}$') THEN 'tollfree'
  WHEN regexp_matches(l, '^[6-9]\d{{9}}$') THEN 'mobile' WHEN d LIKE '+%' AND d NOT LIKE '+91%' THEN 'international' ELSE 'other' END AS kind FROM (
  SELECT msg_id, raw, d, regexp_replace(d, '^\+?91', '') AS l FROM (SELECT msg_id, raw, regexp_replace(raw, '[^\d+]', '', 'g') AS d FROM (
    SELECT msg_id, unnest(regexp_extract_all(norm, '{extract.PHONE}')) AS raw FROM norm))) WHERE length(l) >= 10)"""
_URLS = rf"""urls AS (SELECT DISTINCT msg_id, url FROM (SELECT msg_id, unnest(regexp_extract_all(norm, '\b{extract.URL}')) AS url FROM norm) WHERE url NOT LIKE '%@%')"""
_UNIT = "CASE u " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in dim.MONEY_UNITS.items()) + " ELSE 1.0::DOUBLE END"
_MONEY = rf"""money AS (SELECT msg_id, trim(raw) AS raw, try_cast(replace(n, ',', '') AS DOUBLE) * {_UNIT} AS rupees FROM (
  SELECT msg_id, raw, CASE WHEN n1 <> '' THEN n1 ELSE n2 END AS n, CASE WHEN u1 <> '' THEN u1 ELSE u2 END AS u FROM (SELECT msg_id, {", ".join(f"unnest(regexp_extract_all(norm, '{extract.MONEY}" + chr(92) + f"b', {g})) AS {n}" for g, n in ((0, "raw"), (1, "n1"), (2, "u1"), (3, "n2"), (4, "u2")))} FROM norm)))"""
_PERIOD = r"CASE WHEN regexp_matches(p, '^(day|daily|din|दिन)') THEN 'day' WHEN regexp_matches(p, '^week') THEN 'week' WHEN regexp_matches(p, '^(month|mahina|महीना)') THEN 'month' WHEN regexp_matches(p, '^(year|annum|annual|p\.?a|साल)') THEN 'year' ELSE 'unknown' END"
_RETURNS = rf"""returns AS (SELECT msg_id, trim(raw) AS raw, percent, period,
  least((pow(1 + percent / 100, CASE period WHEN 'day' THEN 365 WHEN 'week' THEN 52 WHEN 'month' THEN 12 ELSE 1 END) - 1) * 100, 1e9::DOUBLE) AS annualised
  FROM (SELECT msg_id, raw, pct::DOUBLE AS percent, {_PERIOD} AS period FROM (
    SELECT msg_id, unnest(regexp_extract_all(norm, '{extract.RETURN}', 0)) AS raw, unnest(regexp_extract_all(norm, '{extract.RETURN}', 1)) AS pct, unnest(regexp_extract_all(norm, '{extract.RETURN}', 2)) AS p FROM norm))
  WHERE percent > 0 AND (period <> 'unknown' OR regexp_matches(raw, '{extract.RETURN_CONTEXT}')))"""
_REGS = rf"""regs AS (SELECT msg_id, upper(reg) AS reg FROM (SELECT msg_id, unnest(regexp_extract_all(norm, '(?i)\b{extract.REGISTRATION}\b', 1)) AS reg FROM norm))"""
_HITS = f"hits AS (SELECT DISTINCT msg_id, family, term FROM norm JOIN {_LEX} ON contains(norm, term))"
_EVIDENCE = rf"""{_NORM}, {_UPI}, {_PHONES}, {_URLS}, {_RETURNS}, {_REGS}, {_HITS},
evidence AS (
  SELECT msg_id, 'LEX_' || upper(family) AS code, weight::DOUBLE AS weight FROM (SELECT DISTINCT msg_id, family FROM hits) JOIN {_FAM} USING (family)
  UNION ALL SELECT msg_id, 'PLAUS_RETURN', CASE WHEN annualised > 200 THEN 4.0 ELSE 2.5 END FROM returns WHERE annualised > 30
  UNION ALL SELECT msg_id, CASE WHEN known THEN 'UPI_PRESENT' ELSE 'UPI_UNKNOWN_PSP' END, CASE WHEN known THEN 1.5 ELSE 2.0 END FROM upi
  UNION ALL SELECT msg_id, CASE kind WHEN 'international' THEN 'PHONE_INTL' ELSE 'PHONE_1600' END, CASE kind WHEN 'international' THEN 1.5 ELSE -1.0 END FROM phones WHERE kind IN ('international', 'trai_1600')
  UNION ALL SELECT DISTINCT msg_id, 'URL_CHEAP_TLD', 1.5 FROM urls WHERE regexp_matches(url, '{extract.CHEAP_TLD}\b')
  UNION ALL SELECT DISTINCT msg_id, 'URL_APK', 3.0 FROM urls WHERE regexp_matches(url, '{extract.APK}\b')
  UNION ALL SELECT msg_id, CASE WHEN status IS NULL THEN 'REG_NOT_FOUND' WHEN status <> 'active' THEN 'REG_INACTIVE' ELSE 'REG_ACTIVE' END, CASE WHEN status IS NULL THEN 2.5 WHEN status <> 'active' THEN 3.0 ELSE -1.5 END FROM regs LEFT JOIN {_REG} r USING (reg)
  UNION ALL SELECT msg_id, 'OBFUSCATION', least(3.0, obfuscation * 0.5) FROM norm WHERE obfuscation >= 2
),
scored AS (SELECT msg_id, greatest(0, coalesce(sum(weight), 0))::DOUBLE AS score, count(DISTINCT CASE WHEN code LIKE 'LEX_%' AND code <> 'LEX_DEFENSIVE' THEN code END) AS families,
  count(CASE WHEN weight > 0 THEN 1 END) AS positive FROM norm LEFT JOIN evidence USING (msg_id) GROUP BY msg_id),
verdicts AS (SELECT msg_id, score, families::INTEGER AS families, positive, CASE WHEN score >= 9 AND families >= 3 THEN 'known_scam' WHEN score >= 5.5 THEN 'likely_scam' WHEN score >= 2.5 THEN 'caution' WHEN score > 0.5 THEN 'unclear' ELSE 'safe_pattern' END AS rung FROM scored)"""


def _exploded(column, *names):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _norm(spark, d).select("msg_id", F.explode(column(F.col("norm"))).alias("h"))
        return rows.select("msg_id", *[F.col(f"h.{n}").alias(n) for n in names])

    return run


def normalize_messages(spark, d):
    return _norm(spark, d).select("msg_id", "norm", "obfuscation")


def zero_width_counts(spark, d):
    return messages(spark, d).select("msg_id", text.zero_width_count(F.col("text")).cast("bigint").alias("n")).where("n > 0")


def canonical_urls(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


_CANON = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
q AS (SELECT page_id, u.scheme AS s, regexp_replace(lower(u.host), '^www\.', '') AS h, CASE WHEN u.path = '' THEN '/' ELSE u.path END AS p,
  list_filter(string_split(substr(u.query, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)^(utm_|fbclid|gclid|igshid|si$|ref$|mc_)')) AS k FROM p)
SELECT page_id, regexp_replace(s || '://' || h || p || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END, '/$', '') AS canonical FROM q"""


def sha256_fingerprint(spark, d):
    return _norm(spark, d).select("msg_id", fingerprint.sha256_hex(F.col("norm")).alias("hash"))


def fnv1a64_names(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", fingerprint.fnv1a64_hex(F.col("p_name")).alias("fnv"))


_FNV = """WITH RECURSIVE c AS (
  SELECT p_partkey, p_name, 0 AS i, 14695981039346656037::HUGEINT AS h FROM part
  UNION ALL
  SELECT p_partkey, p_name, i + 1, (xor(h::UBIGINT, ascii(substr(p_name, i + 1, 1))::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM c WHERE i < length(p_name)
) SELECT p_partkey, lpad(lower(hex(h::UBIGINT)), 16, '0') AS fnv FROM c WHERE i = length(p_name)"""


def lexicon_hits(spark, d):
    return tier0.lexicon_hits(_norm(spark, d), "msg_id")


def automaton_hits(spark, d):
    return tier0.automaton_hits(_norm(spark, d), "msg_id").select("msg_id", "family", "term")


def lexicon_family_counts(spark, d):
    return tier0.lexicon_hits(_norm(spark, d), "msg_id").groupBy("family").agg(F.countDistinct("msg_id").alias("messages"), F.count(F.lit(1)).alias("hits"))


def document_terms(spark, d):
    """The automaton with a dictionary of common words over whole documents."""
    terms = {"en": ["the", "and", "tion", "heed"], "de": ["der", "und", "schein"], "fr": ["les", "eaux"], "es": ["los", "ción"]}
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
    return tier0.automaton_hits(docs, "doc_id", "text", terms).groupBy("family", "term").agg(F.count(F.lit(1)).alias("docs"))


_TERMS = "(VALUES " + ", ".join(f"('{f}', '{t}')" for f, ts in {"en": ["the", "and", "tion", "heed"], "de": ["der", "und", "schein"], "fr": ["les", "eaux"], "es": ["los", "ción"]}.items() for t in ts) + ") AS t(family, term)"


def registry_lookup(spark, d):
    regs = _norm(spark, d).select("msg_id", F.explode(extract.registrations(F.col("norm"))).alias("reg"))
    return regs.join(F.broadcast(dim.registry(spark).select("reg", "kind", "status")), "reg", "left").select("msg_id", "reg", "kind", "status")


def registry_misses(spark, d):
    regs = _norm(spark, d).select(F.explode(extract.registrations(F.col("norm"))).alias("reg"))
    return regs.join(F.broadcast(dim.registry(spark)), "reg", "left_anti").groupBy("reg").agg(F.count(F.lit(1)).alias("n"))


def known_psp_messages(spark, d):
    ids = _norm(spark, d).select("msg_id", F.explode(extract.upi(F.col("norm"))).alias("u")).select("msg_id", "u.handle")
    return ids.join(F.broadcast(dim.psp_handles(spark)), "handle", "left_semi").select("msg_id").distinct()


def tier0_evidence(spark, d):
    return tier0.tier0(messages(spark, d)).select("msg_id", F.explode("evidence").alias("e")).select("msg_id", "e.code", "e.weight")


def tier0_verdict(spark, d):
    return tier0.tier0(messages(spark, d)).select("msg_id", "score", "families", "rung", F.round("confidence", 6).alias("confidence"))


def rung_distribution(spark, d):
    """The flagship: messages through normalisation, extraction and evidence to the share of each verdict."""
    return tier0.tier0(messages(spark, d)).groupBy("rung").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("families").alias("max_families"))


def evidence_by_channel(spark, d):
    rows = tier0.tier0(messages(spark, d)).select("channel", "lang", F.explode("evidence").alias("e"))
    return rows.rollup("channel", "lang").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("e.weight"), 6).alias("weight"))


def rupees_by_lang(spark, d):
    rows = messages(spark, d)
    rows = tier0.normalized(rows).select("lang", F.explode(extract.money(F.col("norm"))).alias("m"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("m.rupees"), 2).alias("rupees"))


def annualise_bands(spark, d):
    rates = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100 + F.col("l_quantity") / 50).alias("pct"), F.element_at(F.array(*map(F.lit, ("day", "week", "month", "year"))), (F.pmod(F.col("l_orderkey"), F.lit(4)) + 1).cast("int")).alias("period"))
    rows = rates.withColumn("annual", plausibility.annualise(F.col("pct"), F.col("period")))
    return rows.withColumn("band", plausibility.band(F.col("annual"))).groupBy("period", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.least("annual", F.lit(1e6))), 3).alias("avg_annual"))


def doubling_time(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", F.round(plausibility.doubling_years((F.col("p_size") + 0.5).cast("double")), 6).alias("years"), F.round(plausibility.month_equivalent(F.col("p_size").cast("double")), 6).alias("monthly"))


def ponzi_recruitment(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.pmod("s_suppkey", F.lit(30)) + 5).cast("double").alias("pct"), (F.pmod("s_suppkey", F.lit(500)) + 1).alias("start"))
    return s.select("s_suppkey", F.posexplode(plausibility.recruitment(F.col("pct"), F.col("start"), 6)).alias("m", "need")).select("s_suppkey", (F.col("m") + 1).alias("month"), F.col("need").cast("bigint").alias("need"))


_PONZI = """WITH RECURSIVE r AS (
  SELECT s_suppkey, (s_suppkey % 30 + 5)::DOUBLE AS pct, 1 AS month, ceil((s_suppkey % 500 + 1)::DOUBLE * ((s_suppkey % 30 + 5)::DOUBLE / 100)) AS need, (s_suppkey % 500 + 1)::DOUBLE AS held FROM supplier
  UNION ALL
  SELECT s_suppkey, pct, month + 1, ceil((held + need) * (pct / 100)), held + need FROM r WHERE month < 6
) SELECT s_suppkey, month, need::BIGINT AS need FROM r"""


def ponzi_collapse(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", ((F.col("p_size") - 3) * 0.75).alias("pct"))
    return p.select("p_partkey", plausibility.collapse_month(F.col("pct")).alias("month"))


_COLLAPSE = """SELECT p_partkey, (SELECT min(m) FROM range(1, 1201) t(m) WHERE 100.0::DOUBLE * pow(1 + pct / 100, m) > 1.45e9::DOUBLE AND pct > 0) AS month
FROM (SELECT p_partkey, (p_size - 3) * 0.75::DOUBLE AS pct FROM part)"""


def _triage(rows: DataFrame) -> DataFrame:
    """A stand-in for model answers, fixed by msg_id."""
    k = F.pmod("msg_id", F.lit(7))
    return rows.select("msg_id", F.when(k == 0, "education").when(k < 4, "investment").otherwise("payment").alias("choice"), (F.pmod("msg_id", F.lit(5)) == 0).alias("abstained")).where(F.pmod("msg_id", F.lit(11)) != 0)


def _answers(rows: DataFrame) -> DataFrame:
    qids = ("pay_to_withdraw", "selling", "otp", "secrecy")
    q = rows.select("msg_id", F.posexplode(F.array(*map(F.lit, qids))).alias("i", "qid"))
    return q.select("msg_id", "qid", (F.pmod(F.col("msg_id") * (F.col("i") + 3), F.lit(100)) / 100).alias("noul"), (F.pmod(F.col("msg_id") + F.col("i"), F.lit(6)) == 0).alias("abstained"))


def tier1_fusion(spark, d):
    rows = tier0.tier0(messages(spark, d)).select("msg_id", "score", "families", "evidence")
    ids = messages(spark, d).select("msg_id")
    return fusion.fuse(rows, _triage(ids), _answers(ids))


_ANSWERS = """triage AS (SELECT msg_id, CASE WHEN msg_id % 7 = 0 THEN 'education' WHEN msg_id % 7 < 4 THEN 'investment' ELSE 'payment' END AS choice, msg_id % 5 = 0 AS abstained FROM msg WHERE msg_id % 11 <> 0),
answers AS (SELECT msg_id, qid, (msg_id * (i + 3) % 100) / 100.0::DOUBLE AS noul, (msg_id + i) % 6 = 0 AS abstained FROM msg, (VALUES (0, 'pay_to_withdraw'), (1, 'selling'), (2, 'otp'), (3, 'secrecy')) q(i, qid))"""
_FUSION = f"""WITH {_EVIDENCE}, {_ANSWERS},
sums AS (SELECT msg_id, sum(CASE WHEN NOT abstained AND noul >= 0.7 THEN CASE qid WHEN 'pay_to_withdraw' THEN 3.0 WHEN 'secrecy' THEN 2.0 ELSE 1.5 END ELSE 0 END)::DOUBLE AS extra,
  count(CASE WHEN NOT abstained AND noul >= 0.7 THEN 1 END) AS yes, max(CASE WHEN qid = 'selling' THEN noul ELSE 0 END) AS selling FROM answers GROUP BY msg_id),
proof AS (SELECT DISTINCT msg_id FROM evidence WHERE weight >= 4),
j AS (SELECT v.msg_id, v.families, t.choice, t.abstained, CASE WHEN t.choice IS NOT NULL THEN v.score + s.extra ELSE v.score END AS added, s.yes, s.selling, p.msg_id IS NOT NULL AS proof
  FROM verdicts v LEFT JOIN triage t USING (msg_id) LEFT JOIN sums s ON s.msg_id = v.msg_id LEFT JOIN proof p ON p.msg_id = v.msg_id),
k AS (SELECT msg_id, CASE WHEN choice = 'education' AND NOT abstained AND NOT proof AND added < 5.5 AND selling < 0.7 THEN greatest(0, added - 1.5) ELSE added END::DOUBLE AS score,
  (families + CASE WHEN choice IS NOT NULL THEN yes ELSE 0 END)::BIGINT AS families, CASE WHEN choice IS NOT NULL THEN 'T0+T1' ELSE 'T0' END AS tier FROM j)
SELECT *, CASE WHEN score >= 9 AND families >= 3 THEN 'known_scam' WHEN score >= 5.5 THEN 'likely_scam' WHEN score >= 2.5 THEN 'caution' WHEN score > 0.5 THEN 'unclear' ELSE 'safe_pattern' END AS rung FROM k"""

_BANK = [("investment", q, i) for i, q in enumerate(("selling", "guaranteed", "pay_to_withdraw", "transfer"))] + [("payment", q, i) for i, q in enumerate(("otp", "remote_app", "transfer"))] + [("education", "selling", 0)]


def followup_plan(spark, d):
    rows = messages(spark, d)
    triage = _triage(rows).select(F.col("msg_id").alias("key"), F.col("choice").alias("triage_key"))
    known = _answers(rows).where("noul >= 0.7 and not abstained").select(F.col("msg_id").alias("key"), "qid")
    return fusion.plan_followups(triage, spark.createDataFrame(_BANK, "triage_key string, qid string, ord int"), known, 2)


_PLAN = f"""WITH msg AS ({MESSAGES_SQL}), {_ANSWERS}, bank AS (SELECT * FROM {dim.sql_values(_BANK, "b(triage_key, qid, ord)")}),
open AS (SELECT t.msg_id AS key, b.qid, b.ord FROM triage t JOIN bank b ON b.triage_key = t.choice
  WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.msg_id = t.msg_id AND a.qid = b.qid AND a.noul >= 0.7 AND NOT a.abstained))
SELECT key, qid, ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS r FROM open) WHERE r <= 2"""


def concept_routing(spark, d):
    return routing.route(_norm(spark, d), "msg_id", "norm")


#: Concepts as structs of minus the score, place and name, best first.
_SCORES = "list_sort([" + ", ".join("{'s': -(" + " + ".join(f"CASE WHEN contains(norm, '{k}') THEN {len(k)} ELSE 0 END" for k in ks) + f"), 'o': {i}, 'c': '{c}'}}" for i, (c, _, ks) in enumerate(dim.CONCEPTS)) + "])"
_ROUTE = f"""WITH {_NORM}, s AS (SELECT msg_id, {_SCORES} AS r FROM norm)
SELECT msg_id, CASE WHEN r[1].s < r[2].s THEN r[1].c END AS concept, (-r[1].s)::BIGINT AS score, (r[2].s - r[1].s)::BIGINT AS margin FROM s"""


def simhash_documents(spark, d):
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.lpad(F.lower(F.hex(fingerprint.simhash64(F.lower("text")))), 16, "0").alias("simhash"))


def near_duplicate_pairs(spark, d):
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id").select("doc_id", fingerprint.simhash64(F.lower("text")).alias("fp"))
    return near_pairs.pairs_within(docs, "doc_id", "fp", 3)


def spoken_cleaning(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.xml_escape(text.spoken_input(F.col("text"), 80)).alias("said"))


_SPOKEN = rf"""SELECT conv_id, turn, replace(replace(replace(replace(replace(left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '{text.SPACE}+', ' ', 'g')), 80), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS said FROM conversations"""


def percent_labels(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("v", F.abs("c_acctbal") * F.pow(F.lit(10.0), F.pmod("c_custkey", F.lit(5)) - 2))
    return c.select("c_custkey", text.percent_label(F.col("v")).alias("label"), text.short_label(F.col("c_name")).alias("short"))


_PERCENT = """WITH v AS (SELECT c_custkey, c_name, abs(c_acctbal) * pow(10.0::DOUBLE, c_custkey % 5 - 2) AS v FROM customer), n AS (SELECT *, round(v)::BIGINT::VARCHAR AS s FROM v), h AS (SELECT *, left(s, length(s) - 3) AS h FROM n)
SELECT c_custkey, CASE WHEN v >= 1e6 THEN 'astronomically' WHEN v >= 1000 THEN CASE WHEN length(h) > 2 THEN left(h, length(h) - 2) || ',' || right(h, 2) ELSE h END || ',' || right(s, 3) || '%'
  ELSE printf('%.1f', CASE WHEN (v * 4) % 2 = 1 THEN v + 0.01 ELSE v END) || '%' END AS label, CASE WHEN length(c_name) > 11 THEN left(c_name, 10) || '…' ELSE c_name END AS short FROM h"""


QUERIES = {
    "rung_distribution": (rung_distribution, f"WITH {_EVIDENCE} SELECT rung, count(*) AS messages, round(avg(score), 6) AS avg_score, max(families) AS max_families FROM verdicts GROUP BY rung"),
    "normalize_messages": (normalize_messages, f"WITH {_NORM} SELECT msg_id, norm, obfuscation FROM norm"),
    "zero_width_counts": (zero_width_counts, f"WITH {_NORM} SELECT msg_id, zw::BIGINT AS n FROM stripped WHERE zw > 0"),
    "canonical_urls": (canonical_urls, _CANON),
    "sha256_fingerprint": (sha256_fingerprint, f"WITH {_NORM} SELECT msg_id, sha256(norm) AS hash FROM norm"),
    "fnv1a64_names": (fnv1a64_names, _FNV),
    "extract_upi": (_exploded(extract.upi, "id", "handle", "known"), f"WITH {_NORM}, {_UPI} SELECT * FROM upi"),
    "extract_phones": (_exploded(extract.phones, "raw", "kind"), f"WITH {_NORM}, {_PHONES} SELECT * FROM phones"),
    "extract_urls": (lambda s, d: _norm(s, d).select("msg_id", F.explode(extract.urls(F.col("norm"))).alias("url")), f"WITH {_NORM}, {_URLS} SELECT * FROM urls"),
    "extract_money": (_exploded(extract.money, "raw", "rupees"), f"WITH {_NORM}, {_MONEY} SELECT * FROM money"),
    "extract_returns": (lambda s, d: _exploded(extract.returns, "raw", "percent", "period", "annualised")(s, d).withColumn("annualised", F.round("annualised", 3)), f"WITH {_NORM}, {_RETURNS} SELECT msg_id, raw, percent, period, round(annualised, 3) AS annualised FROM returns"),
    "extract_registrations": (lambda s, d: _norm(s, d).select("msg_id", F.explode(extract.registrations(F.col("norm"))).alias("reg")), f"WITH {_NORM}, {_REGS} SELECT * FROM regs"),
    "rupees_by_lang": (rupees_by_lang, f"WITH {_NORM}, {_MONEY} SELECT lang, count(*) AS n, round(sum(rupees), 2) AS rupees FROM money JOIN msg USING (msg_id) GROUP BY lang"),
    "lexicon_hits": (lexicon_hits, f"WITH {_NORM}, {_HITS} SELECT * FROM hits"),
    "automaton_hits": (automaton_hits, f"WITH {_NORM}, {_HITS} SELECT * FROM hits"),
    "lexicon_family_counts": (lexicon_family_counts, f"WITH {_NORM}, {_HITS} SELECT family, count(DISTINCT msg_id) AS messages, count(*) AS hits FROM hits GROUP BY family"),
    "document_terms": (document_terms, f"SELECT family, term, count(*) AS docs FROM documents JOIN {_TERMS} ON contains(text, term) GROUP BY 1, 2"),
    "registry_lookup": (registry_lookup, f"WITH {_NORM}, {_REGS} SELECT msg_id, reg, kind, status FROM regs LEFT JOIN {_REG} USING (reg)"),
    "registry_misses": (registry_misses, f"WITH {_NORM}, {_REGS} SELECT reg, count(*) AS n FROM regs ANTI JOIN {_REG} r USING (reg) GROUP BY reg"),
    "known_psp_messages": (known_psp_messages, f"WITH {_NORM}, {_UPI} SELECT DISTINCT msg_id FROM upi WHERE known"),
    "tier0_evidence": (tier0_evidence, f"WITH {_EVIDENCE} SELECT msg_id, code, weight::DOUBLE AS weight FROM evidence"),
    "tier0_verdict": (tier0_verdict, f"WITH {_EVIDENCE} SELECT msg_id, score, families, rung, round(least(0.95, 0.35 + positive * 0.1 + CASE WHEN rung = 'safe_pattern' THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence FROM verdicts"),
    "evidence_by_channel": (evidence_by_channel, f"WITH {_EVIDENCE} SELECT channel, lang, count(*) AS entries, round(sum(weight), 6)::DOUBLE AS weight FROM evidence JOIN msg USING (msg_id) GROUP BY ROLLUP (channel, lang)"),
    "annualise_bands": (annualise_bands, """WITH r AS (SELECT l_discount * 100 + l_quantity / 50 AS pct, ['day', 'week', 'month', 'year'][l_orderkey % 4 + 1] AS period FROM lineitem),
a AS (SELECT period, CASE WHEN pct > 0 THEN least((pow(1 + pct / 100, CASE period WHEN 'day' THEN 365 WHEN 'week' THEN 52 WHEN 'month' THEN 12 ELSE 1 END) - 1) * 100, 1e9::DOUBLE) ELSE 0 END AS annual FROM r)
SELECT period, CASE WHEN annual > 200 THEN 'impossible' WHEN annual > 30 THEN 'implausible' WHEN annual > 15 THEN 'stretch' ELSE 'plausible' END AS band, count(*) AS n, round(avg(least(annual, 1e6::DOUBLE)), 3) AS avg_annual FROM a GROUP BY 1, 2"""),
    "doubling_time": (doubling_time, "SELECT p_partkey, round(ln(2) / ln(1 + (p_size + 0.5::DOUBLE) / 100), 6) AS years, round((pow(1 + p_size::DOUBLE / 100, 1 / 12.0::DOUBLE) - 1) * 100, 6) AS monthly FROM part"),
    "ponzi_recruitment": (ponzi_recruitment, _PONZI),
    "ponzi_collapse": (ponzi_collapse, _COLLAPSE),
    "tier1_fusion": (tier1_fusion, _FUSION),
    "followup_plan": (followup_plan, _PLAN),
    "concept_routing": (concept_routing, _ROUTE),
    "simhash_documents": (simhash_documents, None),
    "near_duplicate_pairs": (near_duplicate_pairs, None),
    "spoken_cleaning": (spoken_cleaning, _SPOKEN),
    "percent_labels": (percent_labels, _PERCENT),
}
