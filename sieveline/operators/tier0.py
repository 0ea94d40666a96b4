"""Deterministic scoring of messages: lexicon hits, evidence and verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, fingerprint, text
from ..functions.plausibility import IMPLAUSIBLE, band
from ..sources.dimensions import FAMILY_WEIGHTS, LEXICON, REGISTRY


def normalized(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with norm (normalised text) and obfuscation (count).

    The one-element explode keeps the optimiser from copying the whole normalisation into each expression that uses norm.
    """
    once = F.explode(F.array(text.normalize(F.coalesce(F.col(text_col), F.lit("")))))
    return messages.withColumn("_n", once).withColumns({"norm": F.col("_n.text"), "obfuscation": F.col("_n.obfuscation")}).drop("_n")


def family_terms(norm: Column, terms: list[str]) -> Column:
    """The terms that occur in norm, in lexicon order."""
    return F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(t)), F.lit(t)) for t in terms]))


def _named(terms: Column, family: str) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(family).alias("family"), t.alias("term")))


def lexicon_hits(rows: DataFrame, key: str, norm: str = "norm", terms: dict[str, list[str]] | None = None) -> DataFrame:
    """key, family, term: one row per distinct term in a text. Pure column expressions; best for short texts."""
    found = F.concat(*[_named(family_terms(F.col(norm), ts), f) for f, ts in (terms or LEXICON).items()])
    return rows.select(key, F.explode(found).alias("h")).select(key, "h.family", "h.term")


def automaton_hits(rows: DataFrame, key: str, norm: str = "norm", terms: dict[str, list[str]] | None = None) -> DataFrame:
    """key, family, term, first_end: the same hits with the end of the first match, in one pass of an automaton per text.

    For long texts: the cost does not grow with the number of terms. Overlapping and nested terms are all reported.
    """
    kind = dict(rows.dtypes)[key]
    table = terms or LEXICON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for f, ts in table.items():
            for t in ts:
                machine.add_word(t, [*machine.get(t, []), (f, t)])
        machine.make_automaton()
        for b in batches:
            at, family, term, end = [], [], [], []
            for i, s in enumerate(b[norm].to_pylist()):
                first: dict[tuple[str, str], int] = {}
                for stop, hits in machine.iter(s or ""):
                    for h in hits:
                        first.setdefault(h, stop)
                for (f, t), stop in first.items():
                    at.append(i), family.append(f), term.append(t), end.append(stop)
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at, pa.int64())), pa.array(family, pa.string()), pa.array(term, pa.string()), pa.array(end, pa.int64())], names=[key, "family", "term", "first_end"])

    return rows.select(key, norm).mapInArrow(run, f"`{key}` {kind}, family string, term string, first_end bigint")


def _entry(code: str | Column, weight: float | Column, source: str) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(wrap(code).alias("code"), wrap(weight).cast("double").alias("weight"), F.lit(source).alias("source"))


def _if(test: Column, entry: Column) -> Column:
    return F.when(test, F.array(entry)).otherwise(F.array().cast("array<struct<code:string,weight:double,source:string>>"))


def registration_status(reg: Column) -> Column:
    """The registry's status of a registration, null if it is not there (a fixed table of a few entries)."""
    out = F.lit(None).cast("string")
    for r, _, _, status, _ in REGISTRY:
        out = F.when(reg == r, status).otherwise(out)
    return out


def evidence(norm: Column, obfuscation: Column) -> Column:
    """array of struct(code, weight, source): one entry per family, one per entity."""
    parts = [_if(F.size(family_terms(norm, ts)) > 0, _entry(f"LEX_{f.upper()}", FAMILY_WEIGHTS[f], "lexicon")) for f, ts in LEXICON.items()]
    claims = F.filter(extract.returns(norm), lambda r: r["annualised"] > IMPLAUSIBLE)
    parts.append(F.transform(claims, lambda r: _entry("PLAUS_RETURN", F.when(band(r["annualised"]) == "impossible", 4.0).otherwise(2.5), "plausibility")))
    parts.append(F.transform(extract.upi(norm), lambda u: _entry(F.when(u["known"], "UPI_PRESENT").otherwise("UPI_UNKNOWN_PSP"), F.when(u["known"], 1.5).otherwise(2.0), "entity")))
    calls = F.filter(extract.phones(norm), lambda p: p["kind"].isin("international", "trai_1600"))
    parts.append(F.transform(calls, lambda p: _entry(F.when(p["kind"] == "international", "PHONE_INTL").otherwise("PHONE_1600"), F.when(p["kind"] == "international", 1.5).otherwise(-1.0), "entity")))
    found = extract.urls(norm)
    parts.append(_if(extract.has_cheap_tld(found), _entry("URL_CHEAP_TLD", 1.5, "entity")))
    parts.append(_if(extract.has_apk(found), _entry("URL_APK", 3.0, "entity")))

    def registered(reg: Column) -> Column:
        status = registration_status(reg)
        code = F.when(status.isNull(), "REG_NOT_FOUND").when(status != "active", "REG_INACTIVE").otherwise("REG_ACTIVE")
        return _entry(code, F.when(status.isNull(), 2.5).when(status != "active", 3.0).otherwise(-1.5), "registry")

    parts.append(F.transform(extract.registrations(norm), registered))
    parts.append(_if(obfuscation >= 2, _entry("OBFUSCATION", F.least(F.lit(3.0), obfuscation * 0.5), "obfuscation")))
    return F.concat(*parts)


def rung(score: Column, families: Column) -> Column:
    return F.when((score >= 9) & (families >= 3), "known_scam").when(score >= 5.5, "likely_scam").when(score >= 2.5, "caution").when(score > 0.5, "unclear").otherwise("safe_pattern")


def tier0(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with norm, obfuscation, evidence, score, families (without the defensive one), rung and confidence.

    One pass without a shuffle: every table it looks into is a fixed constant of the plan.
    """
    rows = normalized(messages, text_col).withColumn("evidence", F.explode(F.array(evidence(F.col("norm"), F.col("obfuscation")))))
    weights = F.transform("evidence", lambda e: e["weight"])
    total = F.greatest(F.lit(0.0), F.aggregate(weights, F.lit(0.0), lambda a, w: a + w))
    flagged = F.size(F.filter("evidence", lambda e: e["code"].startswith("LEX_") & (e["code"] != "LEX_DEFENSIVE")))
    rows = rows.withColumns({"score": total, "families": flagged})
    rows = rows.withColumn("rung", rung(F.col("score"), F.col("families")))
    positive = F.size(F.filter("evidence", lambda e: e["weight"] > 0))
    return rows.withColumn("confidence", F.least(F.lit(0.95), F.lit(0.35) + positive * 0.1 + F.when(F.col("rung") == "safe_pattern", 0.1).otherwise(0.0)))


def fingerprinted(rows: DataFrame, norm: str = "norm") -> DataFrame:
    return rows.withColumns({"hash": fingerprint.sha256_hex(F.col(norm)), "simhash": fingerprint.simhash64(F.col(norm))})


def family_map(hits: DataFrame, key: str) -> DataFrame:
    """key, seq, family, terms, detail from hits (key, family, term, first_end): families by their first hit, each with its terms
    in that order (ties by name), and the first three of them as text."""
    own = hits.groupBy(key, "family").agg(F.array_sort(F.collect_list(F.struct("first_end", "term"))).alias("_h"))
    own = own.select(key, F.struct(F.col("_h")[0]["first_end"].alias("at"), F.col("family"), F.transform("_h", lambda h: h["term"]).alias("terms")).alias("f"))
    listed = own.groupBy(key).agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return listed.select(key, F.posexplode("fs").alias("seq", "f")).select(key, "seq", "f.family", "f.terms", F.array_join(F.slice("f.terms", 1, 3), ", ").alias("detail"))
