"""Registry of runnable queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """Lazy attribute access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles so that summation order cannot show; -0.0 becomes 0.0."""
    cols = []
    for field, kind in df.dtypes:
        if kind in ("double", "float"):
            r = F.round(F.col(f"`{field}`").cast("double"), digits)
            cols.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(field))
        else:
            cols.append(F.col(f"`{field}`"))
    return df.select(*cols)


def query(name: str, oracle: str | None = None, floats: str = "", digits: int = 6):
    """Register ``fn(tables) -> DataFrame``; ``floats`` names the double columns of the oracle."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            sql = oracle.strip()
            if floats:
                parts = ", ".join(
                    f"CASE WHEN round({c}::DOUBLE, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({c}::DOUBLE, {digits}) END AS {c}"
                    for c in floats.split()
                )
                sql = f"SELECT * REPLACE ({parts}) FROM ({sql}) AS checked"
            ORACLES[name] = sql
        return fn

    return wrap
