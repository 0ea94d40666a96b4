"""Reading and writing of row files, and checks of staged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows, dealt by key over all cores where they come in half as many splits or fewer.

    For rows with much work ahead, such as messages: a table of one row group would keep all of it on one core. Tables of many
    splits, as large ones are, stay as they are read and are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def _at(spark: SparkSession, path: str):
    """A path and its file system, whatever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; one that is not there is none to delete."""
    where, files = _at(spark, path)
    files.delete(where, True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line, by an explicit schema; blank lines are skipped, malformed ones give nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, problem: files of the manifest (name, bytes, sha256) that are missing, of another size or changed."""
    joined = manifest.join(found.select("name", F.col("bytes").alias("_b"), F.col("sha256").alias("_s")), "name", "left")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "size").when(F.col("_s") != F.col("sha256"), "changed")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def parse_manifest(raw: DataFrame, column: str) -> DataFrame:
    """schema, model, calibrated, report_only, temperatures and cuts of manifests in a JSON string column; defaults where fields miss."""
    kind = "schema int, modelVersion string, reportOnly boolean, temperature array<double>, temperatures map<string,double>, temperatureByBucket map<string,double>, abstain map<string,double>"
    m = F.from_json(column, kind)
    empty = F.expr("cast(map() as map<string,double>)")
    rows = raw.withColumn("_m", F.explode(F.array(m)))
    by_bucket = F.map_concat(F.map_filter(F.coalesce("_m.temperatures", empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_m.temperatureByBucket", empty)), k)), F.coalesce("_m.temperatureByBucket", empty))
    number, report = F.coalesce("_m.schema", F.lit(1)), F.coalesce("_m.reportOnly", F.lit(False))
    return rows.select(
        *raw.columns, number.alias("schema"), F.coalesce("_m.modelVersion", F.lit("uncalibrated")).alias("model"), ((number >= 2) & (F.size(by_bucket) > 0) & ~report).alias("calibrated"),
        report.alias("report_only"), F.coalesce("_m.temperature", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).alias("by_type"), by_bucket.alias("by_bucket"), F.coalesce("_m.abstain", empty).alias("cuts"),
    )


def build_manifest(rows: DataFrame, extras: dict[str, str] | None = None) -> DataFrame:
    """json: one manifest per row of modelVersion, maxLen, headMaxLen, temperature (array), temperatureByBucket and abstain (maps).

    Temperatures are clamped, cuts rounded to four places, keys of maps in order; extras are more fields of text.
    """
    from ..functions.decode import TYPES, clamp_temperature

    in_order = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    fields = [
        F.lit(2).alias("schema"), "modelVersion", "maxLen", "headMaxLen", F.create_map(*[F.lit(x) for i, t in enumerate(TYPES) for x in (t, i)]).alias("qtypes"),
        F.transform("temperature", clamp_temperature).alias("temperature"), F.transform_values(in_order("temperatureByBucket"), lambda _, t: clamp_temperature(t)).alias("temperatureByBucket"),
        F.transform_values(in_order("abstain"), lambda _, c: F.round(c, 4)).alias("abstain"), *[F.lit(v).alias(k) for k, v in (extras or {}).items()],
    ]
    return rows.select(F.to_json(F.struct(*fields)).alias("json"))


def write_documents(rows: DataFrame, path: str, key: str) -> None:
    """One JSON document per row in a folder for each key; the commit's mark comes last, so that readers see whole writes only."""
    columns = [c for c in rows.columns if c != key]
    rows.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Check records of a history of JSON arrays, one file each; a file that cannot be parsed has none."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})).alias("r")).select("r.*")


def shared_fields(verdicts: DataFrame) -> DataFrame:
    """What is sent to the shared cache: hash, rung and codes, never the text."""
    return verdicts.select("hash", "rung", "codes")
