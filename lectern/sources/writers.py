"""Sinks: Parquet tables, small CSV reports, stage reuse."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.readers import _exists


def write_tables(tables: Mapping[str, DataFrame], folder: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One Parquet directory per table; ``partition_by`` is used where a table has the columns."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        columns = [c for c in partition_by if c in df.columns]
        if columns:
            writer = writer.partitionBy(*columns)
        writer.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_report_csv(df: DataFrame, folders: Sequence[str], name: str) -> None:
    """A small report as one CSV file in each folder (reports have at most a few thousand rows)."""
    for folder in folders:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a stored stage, else build it, store it, and read the stored form."""
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def refuse_non_empty(spark: SparkSession, folder: str) -> None:
    if _exists(spark, f"{folder.rstrip('/')}/*"):
        raise FileExistsError(f"output folder {folder} is not empty")
