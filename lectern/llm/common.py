"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``, under these names, so no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def schema_of(df: DataFrame, *names: str, **added: T.DataType) -> T.StructType:
    """The named fields of ``df`` with their types, all nullable, and the added ones."""
    fields = [T.StructField(n, df.schema[n].dataType, True) for n in names]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in added.items()])


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many parts hold ``rows`` at about ``each`` rows a part."""
    return max(least, math.ceil(rows / each))
