"""From logits and gold rows to decoded answers, their metrics and the groups that do worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decode
from . import calibrate
from .evals import rate

# Yes-or-no questions with metrics of their own.
WITHDRAWAL = "pay_to_withdraw"
IMPERSONATION = ("digital_arrest", "otp", "secrecy", "transfer")
_KEYS = ["row_id", "qid"]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def as_shares(p: Column) -> Column:
    """p made to sum to 1; uniform where it sums to nothing."""
    return F.when(_total(p) > 0, F.transform(p, lambda x: x / _total(p))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def decode_predictions(questions: DataFrame, logits: DataFrame, by_bucket: Column, by_type: Column, cuts: Column) -> DataFrame:
    """questions joined to their logits by (row_id, qid) and decoded; questions without logits are left out.

    questions has row_id, qid, kind, keys and option_order (null: as they stand); logits has row_id, qid and logits, of which the
    first as many as there are keys count. Adds bucket, p (in the order of keys), conf and abstained: softmax at the bucket's
    temperature first, then back to the order of the keys, then the largest share against the bucket's cut.
    """
    rows = questions.join(logits.select(*_KEYS, "logits"), _KEYS)
    k = F.size("keys")
    t = decode.temperature_for(by_bucket, by_type, F.col("kind"), k)
    rows = rows.withColumn("bucket", decode.bucket(F.col("kind"), k)).withColumn("p", decode.softmax(F.slice("logits", F.lit(1), k), t))
    rows = rows.withColumn("p", decode.unpermute(F.col("p"), F.col("option_order"))).withColumn("conf", decode.max_confidence(F.col("p")))
    return rows.withColumn("abstained", F.col("conf") < decode.abstain_for(cuts, F.col("kind"), k)).drop("logits")


def judged(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """predictions (row_id, qid, kind, p) joined to gold (row_id, qid, gold) with conf, correct, yes, gold_yes and score_error."""
    rows = predictions.drop("conf").join(gold.select(*_KEYS, as_shares(F.col("gold")).alias("gold")), _KEYS).withColumn("p", as_shares(F.col("p")))
    half = lambda c: F.try_element_at(c, F.lit(2)) >= 0.5
    gap = F.abs(decode.expected_level(F.col("p")) - decode.expected_level(F.col("gold")))
    return rows.withColumns({
        "conf": decode.max_confidence(F.col("p")), "correct": (decode.argmax(F.col("p")) == decode.argmax(F.col("gold"))).cast("int"),
        "yes": F.when(F.col("kind") == "noul", half(F.col("p"))), "gold_yes": F.when(F.col("kind") == "noul", half(F.col("gold"))),
        "score_error": F.when(F.col("kind") == "score", gap),
    })


def metrics(rows: DataFrame) -> DataFrame:
    """name, value over judged rows with negative: shares, errors and calibration; null where no row is among those that count."""
    right, noul = F.col("correct") == 1, F.col("kind") == "noul"
    one, four = noul & (F.col("qid") == WITHDRAWAL), noul & F.col("qid").isin(*IMPERSONATION)
    negative = F.coalesce("negative", F.lit(False))
    aggs = {
        "accuracy_overall": rate(right, F.lit(True)), "choice_accuracy_min": rate(right, F.col("kind") == "choice"), "noul_accuracy_min": rate(F.col("yes") == F.col("gold_yes"), noul),
        "score_mae": F.avg("score_error"), "brier": F.avg(F.pow(F.col("conf") - F.col("correct"), F.lit(2.0))),
        "precision_pay_to_withdraw_min": rate(F.col("gold_yes"), one & F.col("yes")), "recall_pay_to_withdraw_min": rate(F.col("yes"), one & F.col("gold_yes")),
        "recall_impersonation_min": rate(F.col("yes"), four & F.col("gold_yes")), "false_positive_rate_negatives_max": rate(~right, negative),
        "n": F.count(F.lit(1)).cast("double"), "n_negatives": F.count_if(negative).cast("double"),
    }
    wide = rows.agg(*[v.alias(n) for n, v in aggs.items()])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in aggs])).alias("m")).select("m.*")
    return long.unionByName(calibrate.ece(rows.withColumn("_all", F.lit(1)), "_all").select(F.lit("ece_overall_max").alias("name"), F.col("ece").alias("value")))


def worst_groups(rows: DataFrame) -> DataFrame:
    """name, value, worst: the least accuracy by language and the largest calibration error by bucket, and whose it is (ties: first by name)."""
    by_lang = rows.groupBy("lang").agg(F.avg("correct").alias("v")).agg(F.min(F.struct("v", "lang")).alias("w"))
    by_bucket = calibrate.ece(rows, "bucket").agg(F.min(F.struct((-F.col("ece")).alias("v"), "bucket")).alias("w"))
    low = by_lang.select(F.lit("accuracy_per_language_min").alias("name"), F.col("w.v").alias("value"), F.col("w.lang").alias("worst"))
    return low.unionByName(by_bucket.select(F.lit("ece_per_bucket_max").alias("name"), (-F.col("w.v")).alias("value"), F.col("w.bucket").alias("worst")))


def failures(gates: DataFrame) -> DataFrame:
    """One row: passed, and the names of the gates (name, ok) that are not met, in order of name."""
    return gates.agg(F.bool_and("ok").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failures"))


def ece_report(scored: DataFrame) -> DataFrame:
    """bucket ("overall" for all), ece, n, mean_confidence, accuracy: each row counts for its bucket and for the whole, in one scan."""
    both = scored.select(F.explode(F.array(F.col("bucket"), F.lit("overall"))).alias("bucket"), "conf", "correct")
    return calibrate.ece(both, "bucket")


def risk_coverage(scored: DataFrame, group: str, covers: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """group, aurc, n and the accuracy of the most confident share of rows for each of covers (as selective_<percent>).

    Rows of one confidence count together: each has the error rate of all rows at or above it, and a share ends with the
    confidence that reaches it. Rows are summed by distinct confidence first, so that the window runs over those only.
    """
    values = scored.groupBy(group, "conf").agg(F.count(F.lit(1)).alias("c"), F.sum(1 - F.col("correct")).alias("e"))
    above = Window.partitionBy(group).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    sums = values.select(group, "conf", "c", F.sum("c").over(above).alias("n"), F.sum("e").over(above).alias("e"))
    sums = sums.join(scored.groupBy(group).agg(F.count(F.lit(1)).alias("all")), group)
    shares = [(1 - F.max_by(F.col("e") / F.col("n"), F.when(F.col("n") >= F.ceil(F.lit(c) * F.col("all")), F.col("conf")))).alias(f"selective_{round(100 * c)}") for c in covers]
    return sums.groupBy(group).agg((F.sum(F.col("c") * F.col("e") / F.col("n")) / F.sum("c")).alias("aurc"), F.sum("c").alias("n"), *shares)
