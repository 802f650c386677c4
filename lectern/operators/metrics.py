"""Classification metrics per key, from one row per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import logit, ratio
from lectern.operators.sequence import ordered_features


def score_cells(df: DataFrame, keys: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """Positive and negative weight per (key, score). Ties collapse map-side; nothing later sees raw rows."""
    w = weight if weight is not None else F.lit(1.0)
    return df.groupBy(*keys, F.col(score).cast("double").alias("__s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("__pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("__neg"),
    )


def cumulative_cells(cells: DataFrame, keys: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Cells with the weight below each score and the key's totals.

    Scores in [0, 1] are chunked by value, so a key with very many distinct
    scores is accumulated by many tasks.
    """
    step = chunk if chunk is not None else F.floor(F.col("__s") * 256)
    keyed, by = (cells, list(keys)) if keys else (cells.withColumn("__all", F.lit(1)), ["__all"])
    run = ordered_features(
        keyed, by, ["__s"], chunk=step,
        running={"__pos_below": F.col("__pos"), "__neg_below": F.col("__neg")},
        totals={"__P": F.col("__pos"), "__N": F.col("__neg")},
    )
    return run.drop("__all")


def _f1(hit: Column, false: Column, missed: Column) -> Column:
    return F.coalesce(F.try_divide(2 * hit, 2 * hit + false + missed), F.lit(0.0))


def binary_metrics(
    df: DataFrame, keys: Sequence[str], label: str = "y_true", score: str = "y_score", weight: Column | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """ROC-AUC (ties count half), average precision, Brier, balanced accuracy, macro F1, calibration means.

    All but the calibration means are null when a key has one class only.
    """
    c = cumulative_cells(score_cells(df, keys, label, score, weight), keys)
    s, pos, neg = F.col("__s"), F.col("__pos"), F.col("__neg")
    tp = F.col("__P") - F.col("__pos_below")
    fp = F.col("__N") - F.col("__neg_below")
    high = s >= threshold
    sums = c.groupBy(*keys).agg(
        F.max("__P").alias("__m_p"),
        F.max("__N").alias("__m_n"),
        F.sum(pos * (F.col("__neg_below") + neg / 2)).alias("__m_u"),
        F.sum(pos * F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))).alias("__m_ap"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("__m_sq"),
        F.sum((pos + neg) * s).alias("__m_mean"),
        F.sum(F.when(high, pos).otherwise(0.0)).alias("__m_tp"),
        F.sum(F.when(high, neg).otherwise(0.0)).alias("__m_fp"),
    )
    P, N, tp, fp = F.col("__m_p"), F.col("__m_n"), F.col("__m_tp"), F.col("__m_fp")
    both = (P > 0) & (N > 0)
    total = P + N
    return sums.select(
        *keys,
        total.alias("n_predictions"),
        F.when(both, F.col("__m_u") / (P * N)).alias("roc_auc"),
        F.when(both, F.col("__m_ap") / P).alias("pr_auc"),
        F.when(both, F.col("__m_sq") / total).alias("brier_score"),
        F.when(both, (tp / P + (N - fp) / N) / 2).alias("balanced_accuracy"),
        F.when(both, (_f1(tp, fp, P - tp) + _f1(N - fp, P - tp, fp)) / 2).alias("macro_f1"),
        ratio(F.col("__m_mean"), total).alias("calibration_mean_predicted"),
        ratio(P, total).alias("calibration_observed_rate"),
    )


def averaged_scores(df: DataFrame, keys: Sequence[str], unit: str, label: str = "y_true", score: str = "y_score") -> DataFrame:
    """Scores averaged per unit (over texts, say) before metrics."""
    return df.groupBy(*keys, unit).agg(F.max(label).alias(label), F.avg(score).alias(score))


def calibration_line(df: DataFrame, keys: Sequence[str], label: str = "y_true", score: str = "y_score", iterations: int = 100) -> DataFrame:
    """Intercept and slope of an unpenalised logistic fit of the label on the score's logit.

    Null below three rows, with one class, with constant logits, or where the scores tell
    the classes apart for certain, which leaves no finite fit.
    """
    from lectern.operators.learning import fit_linear_classifiers

    cells = score_cells(df, keys, label, score).withColumn("__x", logit("__s"))
    keyed, by = (cells, list(keys)) if keys else (cells.withColumn("__all", F.lit(1)), ["__all"])
    size = keyed.groupBy(*by).agg(
        F.sum(F.col("__pos") + F.col("__neg")).alias("__n"),
        ((F.sum("__pos") > 0) & (F.sum("__neg") > 0) & (F.min("__x") < F.max("__x")) & (F.sum(F.col("__pos") + F.col("__neg")) >= 3)).alias("__ok"),
    )
    usable = keyed.join(size.where("__ok").select(*by), by, "left_semi")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("__pos").alias("w")), F.struct(F.lit(0).alias("y"), F.col("__neg").alias("w"))))
    rows = usable.select(*by, "__x", sides.alias("o")).select(*by, "__x", F.col("o.y").alias("__y"), F.col("o.w").alias("__w")).where("__w > 0")
    fitted = fit_linear_classifiers(rows, by, ["__x"], "__y", weight="__w", penalty=0.0, iterations=iterations)
    out = size.select(*by).join(fitted.where("status = 'converged'"), by, "left")
    return out.select(*keys, F.get("coefficients", F.lit(0)).alias("calibration_intercept"), F.get("coefficients", F.lit(1)).alias("calibration_slope"))


def leave_one_out_auc(df: DataFrame, unit: str, label: str = "y_true", score: str = "y_score") -> DataFrame:
    """ROC-AUC without each unit, in closed form from the pair counts: no refit, no n x n table."""
    c = cumulative_cells(score_cells(df, [], label, score), [])
    s, pos, neg = F.col("__s"), F.col("__pos"), F.col("__neg")
    pairs = c.agg(F.sum(pos * (F.col("__neg_below") + neg / 2)).alias("__u"))
    from lectern.operators.scalars import with_totals

    as_positive = F.col("__neg_below") + neg / 2
    as_negative = F.col("__P") - F.col("__pos_below") - pos / 2
    held = with_totals(c.select("__s", as_positive.alias("__up"), as_negative.alias("__un"), "__P", "__N"), pairs)
    rows = df.select(unit, label, score).join(held, F.col(score).cast("double") == F.col("__s"))
    yes = F.col(label) == 1
    lost = F.when(yes, F.col("__up")).otherwise(F.col("__un"))
    P = F.col("__P") - F.when(yes, 1).otherwise(0)
    N = F.col("__N") - F.when(yes, 0).otherwise(1)
    return rows.select(
        unit, label, score,
        (F.col("__u") / (F.col("__P") * F.col("__N"))).alias("roc_auc"),
        F.try_divide(F.col("__u") - lost, P * N).alias("leave_one_roc_auc"),
    ).withColumn("delta_roc_auc", F.col("leave_one_roc_auc") - F.col("roc_auc"))
