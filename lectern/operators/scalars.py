"""Attaching one-row aggregates to rows as scalar subqueries: no join, no shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_totals(df: DataFrame, totals: DataFrame, prefix: str = "") -> DataFrame:
    """Add the columns of a one-row frame to every row of ``df``."""
    packed = totals.select(F.struct(*totals.columns).alias("__t")).scalar()
    held = df.withColumn("__t", packed)
    return held.select(*df.columns, *[F.col(f"__t.{c}").alias(prefix + c) for c in totals.columns])


def zscored(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """z-scores with sample SD; a zero or undefined SD gives 0 (null where the value is null)."""
    stats = df.agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns]
    )
    held = with_totals(df, stats)
    scored = {}
    for c in columns:
        sd = F.coalesce(F.col(f"__s_{c}"), F.lit(0.0))
        centred = F.try_divide(F.col(c) - F.col(f"__m_{c}"), sd)
        scored[c + suffix] = F.when(F.col(c).isNotNull(), F.coalesce(centred, F.lit(0.0)))
    return held.withColumns(scored).select(*df.columns, *scored)
