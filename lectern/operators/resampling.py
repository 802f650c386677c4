"""Permutation and bootstrap inference on held-out scores, reproducible through md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lectern.functions.hashing import md5_bucket, md5_hex, md5_int
from lectern.operators.metrics import binary_metrics
from lectern.operators.scalars import with_totals
from lectern.operators.sequence import exact_quantiles, ordered_features, sampled_chunks


def _iterations(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def permuted_labels(scores: DataFrame, unit: str, iterations: int, seed: int, label: str = "y_true") -> DataFrame:
    """Labels dealt anew in every iteration: the P units with the smallest md5 are positive.

    Class sizes never change. The rank is chunked by digest prefix, so an
    iteration over many units is still ranked by many tasks.
    """
    totals = scores.agg(F.sum(label).alias("__P"))
    rows = _iterations(with_totals(scores, totals), iterations)
    hashed = rows.withColumn("__h", md5_hex(F.lit(seed), F.col("iteration"), F.col(unit)))
    ranked = ordered_features(hashed, ["iteration"], ["__h"], chunk=md5_bucket(F.col("__h")), index="__r")
    return ranked.withColumn(label, (F.col("__r") < F.col("__P")).cast("int")).drop("__h", "__r", "__P")


def permutation_test(
    scores: DataFrame, unit: str, iterations: int = 1000, seed: int = 41, label: str = "y_true", score: str = "y_score"
) -> DataFrame:
    """One row: observed AUC, iterations, those at or above it, and p = (1 + hits) / (1 + n)."""
    observed = binary_metrics(scores, [], label, score).select(F.col("roc_auc").alias("observed_roc_auc"))
    dealt = permuted_labels(scores.select(unit, label, score), unit, iterations, seed, label)
    null = with_totals(binary_metrics(dealt, ["iteration"], label, score).select("roc_auc"), observed)
    reached = F.count_if(F.col("roc_auc") >= F.col("observed_roc_auc") - 1e-12)
    return null.agg(
        F.max("observed_roc_auc").alias("observed_roc_auc"),
        F.count("roc_auc").alias("n_permutations"),
        reached.alias("n_at_or_above"),
        ((reached + 1) / (F.count("roc_auc") + 1)).alias("permutation_p_value"),
    )


def bootstrap_weights(scores: DataFrame, unit: str, iterations: int, seed: int, keep: Sequence[str]) -> DataFrame:
    """How often each unit is drawn in each iteration (drawn units only).

    A draw with replacement is a count: slot r of an iteration picks unit
    md5(seed, iteration, r) mod n. Counts combine before they meet the scores.
    """
    ids = scores.select(unit, *keep).withColumn("__all", F.lit(1))
    placed = sampled_chunks(ids, unit, "__cut")
    ranked = ordered_features(placed, ["__all"], [unit], chunk=F.col("__cut"), index="__r", size="__n").drop("__cut")
    draws = _iterations(ranked.select("__r", "__n"), iterations).select(
        "iteration", F.pmod(md5_int(F.lit(seed), F.col("iteration"), F.col("__r")), F.col("__n")).alias("__pick")
    )
    counts = draws.groupBy("iteration", "__pick").agg(F.count(F.lit(1)).alias("weight"))
    # Merged: the draws come from a few units' rows times the iterations, so no size guessed from those may broadcast them.
    return counts.join(ranked.select(F.col("__r").alias("__pick"), unit, *keep).hint("merge"), "__pick").drop("__pick")


def bootstrap_interval(
    scores: DataFrame, unit: str, iterations: int = 2000, seed: int = 41, label: str = "y_true", score: str = "y_score",
    level: float = 0.95,
) -> DataFrame:
    """Percentile interval of ROC-AUC and PR-AUC over resampled units."""
    drawn = bootstrap_weights(scores, unit, iterations, seed, [label, score])
    per_iteration = binary_metrics(drawn, ["iteration"], label, score, weight=F.col("weight").cast("double"))
    long = per_iteration.select("roc_auc", "pr_auc").unpivot([], ["roc_auc", "pr_auc"], "metric", "value")
    tail = (1 - level) / 2
    limits = exact_quantiles(long, ["metric"], "value", {"ci_low": tail, "ci_high": 1 - tail})
    sizes = long.groupBy("metric").agg(F.count("value").alias("n_bootstrap"))
    observed = binary_metrics(scores, [], label, score).select("roc_auc", "pr_auc").unpivot([], ["roc_auc", "pr_auc"], "metric", "observed")
    return observed.join(sizes, "metric").join(limits, "metric")
