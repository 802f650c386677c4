"""Scans of the raw inputs and of stored table sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lectern.functions.ids import normalize_participant


def spread_small_scan(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the cluster has cores.

    One big row group would otherwise keep a heavy projection on one core. A
    table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything on its own file system (local, HDFS, object store)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def observation_csvs(spark: SparkSession, glob: str, schema: StructType, stem_suffix: str = "") -> DataFrame:
    """One CSV per participant; the participant id comes from the file name."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), rf"([^/]+?){stem_suffix}\.[^.]+$", 1)
    scan = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(glob)
    return scan.withColumn("participant_id", normalize_participant(stem))


def optional_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A dimension CSV; an empty table of the same schema when the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def tsv_columns(spark: SparkSession, glob: str, wanted: Sequence[str]) -> DataFrame:
    """Tab-separated report, only the wanted columns it has; a byte-order mark is stripped.

    The header is read as data types only (all strings), so no inference pass runs.
    """
    scan = spark.read.option("sep", "\t").option("header", True).csv(glob)
    clean = scan.toDF(*[c.lstrip("﻿") for c in scan.columns])
    return clean.select(*[c for c in wanted if c in clean.columns])


def table_set(spark: SparkSession, folder: str, names: Sequence[str], suffix: str = ".parquet") -> dict[str, DataFrame]:
    """Name to lazily scanned Parquet table."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}{suffix}") for name in names}


def sharded_scores(
    spark: SparkSession, folder: str, prefix: str, name_filter: str = "*surprisal*.parquet",
    keys: Sequence[str] = ("word_id", "text_id", "paragraph_id", "sentence_id"),
) -> DataFrame:
    """All score shards below a folder as one table; columns that are not keys get a prefix."""
    scan = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_filter).option("mergeSchema", True)
        .parquet(folder)
    )
    return scan.select(*[F.col(c).alias(c if c in keys else f"{prefix}_{c}") for c in scan.columns])


REPORT_SCHEMA = (
    "status string, reports array<struct<context_id: string, status: string, warnings: array<string>, "
    "errors: array<string>, word_count: int, token_count: int>>"
)


def alignment_reports(spark: SparkSession, folder: str, name_filter: str = "alignment_report_shard*.json") -> DataFrame:
    """Shard reports flattened to one row per context."""
    files = (
        spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_filter).json(folder)
    )
    return files.select(F.explode("reports").alias("r")).select("r.*")


def report_counts(reports: DataFrame) -> DataFrame:
    """Counts per (kind, value) for statuses, warnings and errors, in one pass."""
    none = F.array().cast("array<string>")
    tagged = F.concat(
        F.array(F.struct(F.lit("status").alias("kind"), F.coalesce("status", F.lit("missing")).alias("value"))),
        F.transform(F.coalesce("warnings", none), lambda w: F.struct(F.lit("warning").alias("kind"), w.alias("value"))),
        F.transform(F.coalesce("errors", none), lambda e: F.struct(F.lit("error").alias("kind"), e.alias("value"))),
    )
    return reports.select(F.explode(tagged).alias("t")).groupBy("t.kind", "t.value").agg(F.count(F.lit(1)).alias("count"))


def report_examples(reports: DataFrame, limit: int = 200) -> DataFrame:
    """The first contexts that are not ok (a report of at most ``limit`` rows)."""
    shown = reports.where(~F.col("status").eqNullSafe("ok")).select(
        "context_id", "status", F.concat_ws(";", "warnings").alias("warnings"), F.concat_ws(";", "errors").alias("errors"),
        "word_count", "token_count",
    )
    return shown.orderBy("context_id").limit(limit)


def first_available(spark: SparkSession, paths: Sequence[str], rebuild: Callable[[], DataFrame]) -> DataFrame:
    """The first stored table among candidates, else the rebuilt one."""
    for path in paths:
        if _exists(spark, path):
            return spark.read.parquet(path)
    return rebuild()

