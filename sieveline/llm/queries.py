"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_codec import token_file

    return token_file(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score_documents, training_labels

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Host and path rules of the URL query.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, judge_pages

    return judge_pages(table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_weights

    return mix_weights(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict, training_rows

    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", (F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"), "text")
    return predict(rows, model).drop("text")


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_token_codec": op2_token_codec,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_url_filter": op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_near_dup": op7_near_dup,
        "op8_topk": op8_topk,
        "op9_sharding": op9_sharding,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    from .decontaminate import LEAKS_SQL
    from .near_dup import NEAR_SQL
    from .topk import TOPK_SQL

    return {"op3_decontamination": LEAKS_SQL, "op7_near_dup": NEAR_SQL, "op8_topk": TOPK_SQL}
