"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import delete_folder, scratch_dir, table
from sieveline.llm.decontaminate import remove_leaks
from sieveline.llm.language_id import fit, reject_unknown, training_rows
from sieveline.llm.mixing import sample_copies
from sieveline.llm.near_dup import drop_near_duplicates
from sieveline.llm.sharding import shard_documents

SHARDS = 8
#: Documents are near duplicates from this percent of similarity on; op7 has its own.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told; the model learns from the stage's own labelled input.

    Null, empty and letterless texts go, and all rows where none is labelled; other cases as in reject_unknown."""
    return reject_unknown(docs, fit(training_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, judged by id and text; cases as in drop_near_duplicates."""
    return drop_near_duplicates(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; cases as in remove_leaks."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the raked source, language and topic weights; those wanted more than once come in copies.

    Cases as in sample_copies."""
    return sample_copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document: doc_id, size, text_crc32, law, shard, slot, grown_shard; cases as in shard_documents."""
    return shard_documents(docs, SHARDS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The learned language model and the minwise join are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's Parquet is deleted once the next one is written; the last one stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_folder(spark, last)
        last = path
    return docs
