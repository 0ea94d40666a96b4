"""Question banks from JSON: rows of questions, their keys, labels and limits, and the rules that they have to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a bank's questions.
KINDS, CHOICES, LEVELS, INSTRUCTIONS = ("choice", "score", "noul"), (2, 20), (2, 10), 300
NOUL_KEYS = ("false", "true")
_QUESTION = "bank string, triage_key string, qid string, type string, instructions string, criteria string, labels map<string,string>"


def load_questions(raw: DataFrame, column: str) -> DataFrame:
    """Questions of JSON objects in a string column, one each, with `criteria` as a map or `levels` as a list; malformed ones give nulls."""
    rows = raw.select(F.from_json(column, _QUESTION).alias("q")).select("q.*").withColumnRenamed("type", "kind")
    levels = F.when(F.startswith("criteria", F.lit("[")), F.from_json("criteria", "array<string>"))
    return rows.withColumn("levels", levels).withColumn("criteria", F.when(F.startswith("criteria", F.lit("{")), F.from_json("criteria", "map<string,string>")))


def option_keys(kind: Column, criteria: Column, levels: Column) -> Column:
    """Answer keys in order: a choice's own, a score's positions, false and true."""
    places = F.when(F.size(levels) > 0, F.transform(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(kind == "choice", F.map_keys(criteria)).when(kind == "score", places).otherwise(F.array(*map(F.lit, NOUL_KEYS)))


def noul_labels(labels: Column) -> Column:
    """struct(false, true) of the trimmed labels, the keys themselves without any; null where they are not two different texts for just those keys."""
    no, yes = (F.trim(F.try_element_at(labels, F.lit(k))) for k in NOUL_KEYS)
    good = (F.size(labels) == 2) & (no != "") & (yes != "") & (no != yes)
    return F.when(labels.isNull(), F.struct(F.lit("false").alias("no"), F.lit("true").alias("yes"))).when(good, F.struct(no.alias("no"), yes.alias("yes")))


def broken_rules(questions: DataFrame, triage_keys: DataFrame) -> DataFrame:
    """bank, qid, rule: the rules that loaded questions break; triage_keys has the (bank, triage_key) that there are."""
    known = triage_keys.select("bank", "triage_key").distinct().withColumn("_known", F.lit(True))
    rows = questions.join(known, ["bank", "triage_key"], "left")
    choice, score, noul = (F.col("kind") == k for k in KINDS)
    keys = F.map_keys("criteria")
    rules = {
        "type": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "options": (choice & ~F.coalesce(F.size(keys), F.lit(0)).between(*CHOICES)) | (score & ~F.coalesce(F.size("levels"), F.lit(0)).between(*LEVELS)),
        "empty_key": choice & F.exists(keys, lambda k: k == ""),
        "description": choice & F.exists(F.map_values("criteria"), lambda v: v.isNull() | v.rlike("^[\\[{]")),
        "noul_keys": noul & (F.size(F.array_except(keys, F.array(*map(F.lit, NOUL_KEYS)))) > 0),
        "labels": F.col("labels").isNotNull() & (~noul | noul_labels(F.col("labels")).isNull()),
        "instructions": (F.coalesce("instructions", F.lit("")) == "") | (F.length("instructions") > INSTRUCTIONS) | F.contains("instructions", F.lit("\n")),
        "triage_key": F.col("triage_key").isNotNull() & F.col("_known").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select("bank", "qid", F.explode(broken).alias("rule"))


def most_questions(questions: DataFrame) -> DataFrame:
    """bank, most: the triage question and the longest of the follow-ups that a triage answer can lead to."""
    asked = questions.groupBy("bank", "triage_key").agg(F.count_if(F.col("triage_key").isNotNull()).alias("n"))
    return asked.groupBy("bank").agg((F.max("n") + 1).alias("most"))


def canonical_sha(fields: Column) -> Column:
    """sha256 of a map as compact JSON with its keys in order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))), 256)


def without_mask(text: Column, mask: Column | str) -> Column:
    """text with every mask token replaced by a space."""
    return F.replace(text, F.lit(mask) if isinstance(mask, str) else mask, F.lit(" "))
