"""Held-out scores to evaluate: a stated function of each reader, no fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions.ids import normalize_participant


def reader_scores(t) -> DataFrame:
    """Three models' scores of every labelled reader, rounded so that ties occur."""
    label = F.when(F.col("s_acctbal") >= 6000, 1).when(F.col("s_acctbal") <= 4000, 0)
    base = t.supplier.select("s_suppkey", "s_acctbal", label.alias("y_true")).where("y_true IS NOT NULL")
    rows = base.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    noise = ((F.col("s_suppkey") * 7 + F.col("model") * 13) % 11 - 5) / 2.0
    return rows.select(
        normalize_participant(F.concat(F.lit("p"), F.col("s_suppkey"))).alias("participant_id"),
        "model",
        "y_true",
        F.round(1.0 / (1.0 + F.exp(-((F.col("s_acctbal") - 5000) / 4000.0 + noise))), 2).alias("y_score"),
    )


def one_model(t, model: int = 0) -> DataFrame:
    return reader_scores(t).where(F.col("model") == model).drop("model")
