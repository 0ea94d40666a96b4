"""Question banks: rendering, validation, explanations and spoken lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..sources.dimensions import FAMILY_LABELS

NO, YES = "no, the statement does not hold", "yes, the statement holds"
#: One line per language and kind of verdict, in our own words.
SPOKEN = {
    "en": {"danger": "Stop. This matches a known fraud. Do not pay. Call 1930.", "careful": "Be careful. Check with someone you trust before you pay.", "unsure": "We cannot tell. Do not share codes or money yet.", "calm": "We found no sign of fraud in this message."},
    "hi": {"danger": "रुकिए। यह ठगी जैसा है। पैसे न दें। 1930 पर कॉल करें।", "careful": "सावधान रहें। पैसे देने से पहले भरोसेमंद व्यक्ति से पूछें।", "unsure": "हम तय नहीं कर सके। अभी कोड या पैसे न दें।", "calm": "इस संदेश में ठगी का संकेत नहीं मिला।"},
}


def render_options(kind: Column, keys: Column, texts: Column) -> Column:
    """The options as shown to a model: "key: text" for choices, "level i: text" for scores, two fixed forms for yes or no."""
    choice = F.zip_with(keys, texts, lambda k, t: F.when(F.coalesce(t, F.lit("")) == "", k).otherwise(F.concat(k, F.lit(": "), t)))
    score = F.transform(texts, lambda t, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), t))
    given = lambda k, d: F.coalesce(F.nullif(F.try_element_at(texts, F.nullif(F.array_position(keys, k), F.lit(0)).cast("int")), F.lit("")), F.lit(d))
    noul = F.array(F.concat(F.lit("false: "), given("false", NO)), F.concat(F.lit("true: "), given("true", YES)))
    return F.when(kind == "choice", choice).when(kind == "score", score).otherwise(noul)


def bank_violations(bank: DataFrame) -> DataFrame:
    """bank, qid, rule: broken rules of questions (bank, triage_key, qid, kind, instructions, n_options, triage_keys)."""
    rules = {
        "type": ~F.col("kind").isin("choice", "score", "noul"),
        "options": ((F.col("kind") == "choice") & ~F.col("n_options").between(2, 20)) | ((F.col("kind") == "score") & ~F.col("n_options").between(2, 10)),
        "instructions": (F.coalesce("instructions", F.lit("")) == "") | (F.length("instructions") > 300) | F.col("instructions").contains("\n"),
        "triage_key": F.col("triage_key").isNotNull() & ~F.array_contains("triage_keys", F.col("triage_key")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return bank.select("bank", "qid", F.explode(broken).alias("rule"))


def explain(codes: DataFrame, key: str) -> DataFrame:
    """key, text: a fixed explanation from evidence codes (key, seq, code): the known families' labels as bullets and a footer."""
    label = F.lit(None).cast("string")
    family = F.lower(F.regexp_replace("code", "^LEX_", ""))
    for f, t in FAMILY_LABELS.items():
        label = F.when(family == f, t).otherwise(label)
    lines = codes.withColumn("_l", label).groupBy(key).agg(F.sort_array(F.collect_set(F.when(F.col("_l").isNotNull(), F.struct("seq", F.concat(F.lit("- "), F.col("_l")).alias("t"))))).alias("_s"))
    body = F.array_join(F.transform("_s", lambda x: x["t"]), "\n")
    return lines.select(key, F.concat(F.when(F.size("_s") > 0, F.concat(body, F.lit("\n"))).otherwise(""), F.lit("Report fraud: 1930.")).alias("text"))


def spoken_line(rung: Column, lang: Column) -> Column:
    mood = F.when(rung.isin("known_scam", "likely_scam"), "danger").when(rung == "caution", "careful").when(rung == "unclear", "unsure").otherwise("calm")
    out = F.lit(None).cast("string")
    for code, lines in SPOKEN.items():
        for m, line in lines.items():
            out = F.when((F.when(F.lower(lang).startswith("hi"), "hi").otherwise("en") == code) & (mood == m), line).otherwise(out)
    return out


def voice_response(line: Column, lang: Column) -> Column:
    """An XML answer that says one line and hangs up."""
    tag = F.when(F.lower(lang).startswith("hi"), "hi-IN").otherwise("en-IN")
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Response><Say language="'), tag, F.lit('">'), xml_escape(line), F.lit("</Say><Hangup/></Response>"))


def redact_stream(chunks: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, text, redacted: a stream's chunks (key, seq, chunk) joined in order and cut at the first forbidden match."""
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("_t"))
    hit = F.regexp_instr("_t", F.lit(pattern))
    return joined.select(key, F.when(hit > 0, F.concat(F.substring("_t", F.lit(1), hit - 1), F.lit("[removed]"))).otherwise(F.col("_t")).alias("text"), (hit > 0).alias("redacted"))


def default_bank(spark: SparkSession) -> DataFrame:
    rows = [("demo", None, "triage", "choice", "What is this message about?", 3, ["investment", "payment", "education"]), ("demo", "payment", "otp", "noul", "Does it ask for a code?", 2, ["investment", "payment", "education"]), ("demo", "loans", "fee", "noul", "", 2, ["investment", "payment", "education"]), ("demo", "payment", "risk", "score", "How risky is it?", 11, ["investment", "payment", "education"])]
    return spark.createDataFrame(rows, "bank string, triage_key string, qid string, kind string, instructions string, n_options int, triage_keys array<string>")
