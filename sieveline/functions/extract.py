"""Entities in normalised texts as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dimensions import MAIL_HOSTS, MONEY_UNITS, PSP_HANDLES
from .plausibility import annualise

#: An ASCII word boundary: Java's own follows Unicode letters.
_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"

# The patterns of the entities, leftmost alternative first.
UPI = r"([a-z0-9._-]{2,64})@([a-z]{2,32})"
PHONE = r"(?:\+?\d[\d\s-]{8,15}\d)"
URL = r"(?:https?:\/\/)?(?:[a-z0-9-]+\.)+(?:com|in|net|org|io|xyz|top|club|app|site|online|info|co|me|link|live)(?:\/[^\s]*)?"
MONEY = r"(?:₹|rs\.?|inr|rupees?)\s?([\d,]+(?:\.\d+)?)\s?(lakh|lac|lakhs|crore|cr|k|thousand)?|([\d,]+(?:\.\d+)?)\s?(lakh|lac|lakhs|crore|cr)"
RETURN = r"(\d{1,4}(?:\.\d+)?)\s?%\s*(?:return|profit|returns|interest|gain|munafa|मुनाफा|रिटर्न)?\s*(?:per|a|every|\/|in|प्रति)?\s*(day|daily|week|weekly|month|monthly|year|yearly|annum|annual|p\.a\.|pa|din|mahina|महीना|दिन|साल)?"
REGISTRATION = r"(in[ah]\d{9})"
RETURN_CONTEXT = "return|profit|interest|gain|munafa|मुनाफा|रिटर्न"
CHEAP_TLD = r"\.(xyz|top|club|site|online|live|link)"
APK = r"\.apk"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _zip(text: Column, pattern: str, names: list[tuple[str, int]]) -> Column:
    return F.arrays_zip(*[_all(text, pattern, g).alias(n) for n, g in names])


def upi(text: Column) -> Column:
    """id, handle, known: name@handle except mail hosts."""
    hits = _zip(text, _EDGE + UPI + _EDGE, [("id", 0), ("handle", 2)])
    kept = F.filter(hits, lambda h: ~h["handle"].isin(*MAIL_HOSTS))
    return F.transform(kept, lambda h: F.struct(h["id"].alias("id"), h["handle"].alias("handle"), h["handle"].isin(*PSP_HANDLES).alias("known")))


def phones(text: Column) -> Column:
    """raw, kind: digit runs of ten digits or more once a leading country code 91 is taken off."""

    def one(raw: Column) -> Column:
        digits = F.regexp_replace(raw, r"[^\d+]", "")
        local = F.regexp_replace(digits, r"^\+?91", "")
        kind = (
            F.when(local.rlike(r"^1600\d{6}$"), "trai_1600").when(local.rlike(r"^1800\d{6,7}$"), "tollfree").when(local.rlike(r"^[6-9]\d{9}$"), "mobile")
            .when(digits.startswith("+") & ~digits.startswith("+91"), "international").otherwise("other")
        )
        return F.struct(F.trim(raw).alias("raw"), kind.alias("kind"), F.length(local).alias("size"))

    found = F.filter(F.transform(_all(text, PHONE), one), lambda p: p["size"] >= 10)
    return F.transform(found, lambda p: F.struct(p["raw"].alias("raw"), p["kind"].alias("kind")))


def urls(text: Column) -> Column:
    """Distinct addresses in order of appearance, none with an @."""
    return F.filter(F.array_distinct(_all(text, _EDGE + URL)), lambda u: ~F.contains(u, F.lit("@")))


def money(text: Column) -> Column:
    """raw, rupees: null where the number is only commas."""
    hits = _zip(text, "(?:" + MONEY.replace("|(", "|(", 1) + _EDGE + ")", [("raw", 0), ("n1", 1), ("u1", 2), ("n2", 3), ("u2", 4)])

    def one(h: Column) -> Column:
        number = F.when(h["n1"] != "", h["n1"]).otherwise(h["n2"])
        unit = F.when(h["u1"] != "", h["u1"]).otherwise(h["u2"])
        factor = F.lit(1.0)
        for name, value in MONEY_UNITS.items():
            factor = F.when(unit == name, value).otherwise(factor)
        return F.struct(F.trim(h["raw"]).alias("raw"), (F.replace(number, F.lit(","), F.lit("")).try_cast("double") * factor).alias("rupees"))

    return F.transform(hits, one)


def period_of(word: Column) -> Column:
    return (
        F.when(word.rlike("^(day|daily|din|दिन)"), "day").when(word.rlike("^week"), "week").when(word.rlike("^(month|mahina|महीना)"), "month")
        .when(word.rlike(r"^(year|annum|annual|p\.?a|साल)"), "year").otherwise("unknown")
    )


def returns(text: Column) -> Column:
    """raw, percent, period, annualised: positive rates with a period or a word of profit."""
    hits = _zip(text, RETURN, [("raw", 0), ("percent", 1), ("period", 2)])
    typed = F.transform(hits, lambda h: F.struct(h["raw"].alias("raw"), h["percent"].cast("double").alias("percent"), period_of(h["period"]).alias("period")))
    kept = F.filter(typed, lambda h: (h["percent"] > 0) & ((h["period"] != "unknown") | h["raw"].rlike(RETURN_CONTEXT)))
    return F.transform(kept, lambda h: F.struct(F.trim(h["raw"]).alias("raw"), h["percent"].alias("percent"), h["period"].alias("period"), annualise(h["percent"], h["period"]).alias("annualised")))


def registrations(text: Column) -> Column:
    return F.transform(_all(text, "(?i)" + _EDGE + REGISTRATION + _EDGE, 1), F.upper)


def has_cheap_tld(found_urls: Column) -> Column:
    return F.exists(found_urls, lambda u: u.rlike(CHEAP_TLD + _EDGE))


def has_apk(found_urls: Column) -> Column:
    return F.exists(found_urls, lambda u: u.rlike(APK + _EDGE))


def is_registration(text: Column) -> Column:
    return text.rlike(r"(?i)^IN[AH]\d{9}$")


def in_app_browser(agent: Column) -> Column:
    return F.when(agent.rlike(r"(?i)FBAN|FBAV|Instagram|WhatsApp|Line/|MicroMessenger|; wv\)"), True).otherwise(False)
