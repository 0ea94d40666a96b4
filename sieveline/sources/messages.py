"""A message table made from orders, in DataFrame functions and as SQL: every signal the engine looks for occurs in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import sql_values
from .files import spread

#: {p}, {a} and {n} are filled with a rate, an amount and ten digits of each order.
PIECES = (
    "Guaranteed return {p}% daily profit, pay ₹{a} lakh to agent{n}@ybl today only",
    "Join our VIP group for sure shot multibagger tips, call +1 {n} now http://fast-{a}.xyz/join",
    "Your KYC expired, account will be blocked. Install this app http://kyc-{a}.top/secure.apk",
    "CBI officer here: digital arrest, stay on video call and do not tell anyone. Pay rs {a},000 to desk.{a}@fakebank",
    "SEBI warns: beware of unregistered tips, never share OTP. Report to 1930 or cybercrime.gov.in",
    "INA000017001 registered adviser, fixed plan {p}% per year, call 1600{a}12345 or 1600123456",
    "Research desk INH000009002 says target hit, profit {p}% monthly, send to desk@okaxis",
    "Adviser INA999{n} promises assured return {p}% per month",
    "Withdrawal tax pending: pay {a} crore clearance fee to unlock your profit, contact 98{n}",
    "Gu\u200bar\u0430nteed pr\u043efit ३% r\u0435turn w\u200cithin 24 hours",
    "गारंटी रिटर्न {p}% महीना, आज ही जुड़ें, vip ग्रुप",
    "Family dinner at {a} o'clock, bring the cake please",
    "mail me at person{a}@gmail.com or visit www.example.com/page{a}",
    "",
    "Rs.{a} due on your loan, interest {p}% p.a. — see https://bank.in/pay?id={a}",
    "  Mixed   spaces\tand\nlines {p}% gain in  week  ",
    "anydesk {a} screen share karo, jaldi karo, toll free 1800{a}4567 or 18001234567",
    "insider tip: operator game, big news coming, 0.{a}% day profit; pay rupees 5 k",
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, text, lang, channel, ts: one message per order, two pieces for every third."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    pieces = F.array(*[F.lit(p) for p in PIECES])
    key, n = F.col("o_orderkey"), F.lit(len(PIECES))
    first = F.element_at(pieces, (F.pmod(key, n) + 1).cast("int"))
    second = F.element_at(pieces, (F.pmod(F.floor(key / 7), n) + 1).cast("int"))
    text = F.when(F.pmod(key, F.lit(3)) == 0, F.concat(first, F.lit(". "), second)).otherwise(first)
    for slot, value in (("{p}", F.pmod(F.col("o_custkey"), F.lit(40)) + 1), ("{a}", F.pmod(key, F.lit(89)) + 1), ("{n}", F.lpad(F.pmod(key * 7919, F.lit(100000000)).cast("string"), 8, "6"))):
        text = F.replace(text, F.lit(slot), value.cast("string"))
    langs, channels = F.array(*map(F.lit, ("en", "hi", "mr"))), F.array(*map(F.lit, ("paste", "voice", "share")))
    return o.select(
        key.alias("msg_id"), text.alias("text"), F.element_at(langs, (F.pmod(key, F.lit(3)) + 1).cast("int")).alias("lang"),
        F.element_at(channels, (F.pmod(F.col("o_custkey"), F.lit(3)) + 1).cast("int")).alias("channel"), F.col("o_orderdate").alias("ts"),
    )


_LIST = sql_values([(i, p) for i, p in enumerate(PIECES)], "pieces(i, p)")
#: The same table for DuckDB, as the body of a WITH entry.
MESSAGES_SQL = f"""
SELECT o_orderkey AS msg_id,
  replace(replace(replace(CASE WHEN o_orderkey % 3 = 0 THEN a.p || '. ' || b.p ELSE a.p END,
    '{{p}}', (o_custkey % 40 + 1)::VARCHAR), '{{a}}', (o_orderkey % 89 + 1)::VARCHAR), '{{n}}', lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '6')) AS text,
  ['en', 'hi', 'mr'][o_orderkey % 3 + 1] AS lang, ['paste', 'voice', 'share'][o_custkey % 3 + 1] AS channel, o_orderdate AS ts
FROM orders JOIN (SELECT * FROM {_LIST}) a ON a.i = o_orderkey % {len(PIECES)} JOIN (SELECT * FROM {_LIST}) b ON b.i = (o_orderkey // 7) % {len(PIECES)}
"""
