"""Text normalisation as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in the sense of Unicode-aware engines, spelled out because Java's own class is ASCII only; and zero-width characters.
_hex = lambda ranges: "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)
SPACE = "[" + _hex([(9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]) + "]"
ZERO_WIDTH = "[" + _hex([(0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0xFEFF, 0xFEFF), (0xAD, 0xAD), (0x180E, 0x180E)]) + "]"

# Look-alike letters and what they are folded to, position by position.
LOOKALIKES = "аеорсухіјѕһԁӏԛԝАВЕКМНОРСТХУІαορεικντυχΑΒΕΖΗΙΚΜΝΟΡΤΧΥıɡǃ"
FOLDED_TO = "aeopcyxijshdlqwabekmhopctxyiaopeikvtuxabezhikmnoptxyig!"
# The zero digits of the scripts whose digits are folded.
DIGIT_ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660, 0x06F0)
DIGITS = "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10))
DIGITS_TO = "0123456789" * len(DIGIT_ZEROS)
# Query parameters that only track.
TRACKING = r"(?i)^(utm_|fbclid|gclid|igshid|si$|ref$|mc_)"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """NFKC; pure ASCII texts skip Python's normaliser (a null is sent in their place)."""
    wide = text.rlike("[^\\x00-\\x7F]")
    return F.coalesce(_nfkc(F.when(wide, text)), text)


def zero_width_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ZERO_WIDTH))


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def lookalike_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{LOOKALIKES}]"))


def fold(text: Column) -> Column:
    """Native digits to 0-9 and look-alike letters to ASCII."""
    return F.translate(text, DIGITS + LOOKALIKES, DIGITS_TO + FOLDED_TO)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def canonical_url(raw: Column) -> Column:
    """Scheme added if missing, host lower-cased without www., no fragment, tracking parameters or trailing slash.

    What has no host after that is the lower-cased input. Percent-encoding and dot segments are left as they are.
    """
    url = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = lambda k: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    scheme, host = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    params = F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&"), lambda p: ~F.split(p, "=")[0].rlike(TRACKING) & (p != ""))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    built = F.regexp_replace(F.concat(scheme, F.lit("://"), host, path, query), "/$", "")
    return F.when(host == "", F.lower(raw)).otherwise(built)


def canonical_urls_in(text: Column) -> Column:
    """Every http(s) address in a text replaced by its canonical form, white space collapsed and trimmed."""

    def one(token: Column) -> Column:
        before = F.regexp_extract(token, r"^(.*?)https?://.+", 1)
        url = F.regexp_extract(token, r"https?://.+", 0)
        return F.when(url != "", F.concat(before, canonical_url(url))).otherwise(token)

    tokens = F.split(collapse(text), " ")
    return F.when(F.contains(text, F.lit("://")), F.array_join(F.transform(tokens, one), " ")).otherwise(collapse(text))


def normalize(text: Column) -> Column:
    """struct(text, obfuscation): NFKC, zero-width stripped, folded, lower case, canonical addresses, single spaces.

    obfuscation counts the stripped characters and the folded letters, not folded digits.
    """
    wide = nfkc(text)
    bare = strip_zero_width(wide)
    return F.struct(canonical_urls_in(F.lower(fold(bare))).alias("text"), (zero_width_count(wide) + lookalike_count(bare)).alias("obfuscation"))


def spoken_input(raw: Column, limit: int = 1200) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(raw, r"[\x00-\x1F\x7F]", " "), SPACE + "+", " ")), F.lit(limit))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def one_decimal(v: Column) -> Column:
    """The nearest number of one decimal to the exact value of a non-negative double; halves go up."""
    half = F.pmod(v * 4, F.lit(2.0)) == 1
    return F.replace(F.format_number(F.when(half, v + 0.01).otherwise(v), 1), F.lit(","), F.lit(""))


def percent_label(v: Column) -> Column:
    """One decimal below 1000 %, rounded whole numbers below a million, else a word."""
    return F.when(v >= 1e6, "astronomically").when(v >= 1000, F.concat(indian_grouping(F.round(v).cast("bigint")), F.lit("%"))).otherwise(F.concat(one_decimal(v), F.lit("%")))


def indian_grouping(n: Column) -> Column:
    """Digits grouped three, then by twos."""
    s = n.cast("string")
    head = F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(s) > 3, F.concat(head, F.lit(","), F.right(s, F.lit(3)))).otherwise(s)


def short_number(n: Column) -> Column:
    return F.when(n >= 1e5, F.concat(one_decimal(n / 1e5), F.lit("L"))).when(n >= 1e3, F.concat(one_decimal(n / 1e3), F.lit("k"))).otherwise(n.cast("bigint").cast("string"))


def short_label(s: Column) -> Column:
    return F.when(F.length(s) > 11, F.concat(F.left(s, F.lit(10)), F.lit("…"))).otherwise(s)
