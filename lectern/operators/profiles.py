"""Reader profiles built on residuals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import slope
from lectern.operators.sequence import exact_quantiles, unpivot_values


def contrast(value: str, condition: Column) -> Column:
    """Mean where a condition holds minus the mean where it does not; null counts as not."""
    hit = F.coalesce(condition, F.lit(False))
    return F.avg(F.when(hit, F.col(value))) - F.avg(F.when(~hit, F.col(value)))


#: Rows of a unit whose values a task may hold at once.
HELD = 1_000_000


def residual_profiles(
    df: DataFrame, unit: str, residuals: Sequence[str], predictors: Mapping[str, str], *,
    opacity: str = "prev_boundary_opacity_score", vv: str = "vv_indicator", exposures: Mapping[str, str] | None = None,
    parts: int | None = None, largest: int | None = None,
) -> DataFrame:
    """Per unit: mean, median and SD of every residual, its slopes (five pairs at least), its costs, and exposure means.

    Rows of units of at most ``HELD`` rows move once, to their unit (dealt over ``parts`` tasks where
    given), which takes the exact medians along. For a larger unit, which ``largest`` tells, sums
    combine before they move and the medians take a long-form pass.
    """
    aggs: list[Column] = []
    for r in residuals:
        aggs += [F.avg(r).alias(f"{r}_mean"), F.stddev_samp(r).alias(f"{r}_sd")]
        aggs += [slope(F.col(r), F.col(c), 5).alias(f"{r}_{name}_slope") for name, c in predictors.items()]
        aggs += [contrast(r, F.col(opacity) == 3).alias(f"{r}_high_opacity_cost"), contrast(r, F.col(vv) == 1).alias(f"{r}_vv_cost")]
    aggs += [F.avg(F.col(c).cast("double")).alias(name) for name, c in (exposures or {}).items()]
    if largest is not None and largest <= HELD:
        used = dict.fromkeys([unit, *residuals, *predictors.values(), opacity, vv, *(exposures or {}).values()])
        rows = df.select(*used)
        together = rows.repartition(parts, unit) if parts else rows.repartition(unit)
        return together.groupBy(unit).agg(*aggs, *[F.percentile(F.col(r).cast("double"), 0.5).alias(f"{r}_median") for r in residuals])
    base = df.groupBy(unit).agg(*aggs)
    long = unpivot_values(df, [unit], residuals, "__r", "__v")
    found = exact_quantiles(long, [unit, "__r"], "__v", {"__m": 0.5})
    medians = found.groupBy(unit).agg(*[F.max(F.when(F.col("__r") == r, F.col("__m"))).alias(f"{r}_median") for r in residuals])
    return base.join(medians, unit, "left")


def combine_profiles(first: DataFrame, second: DataFrame, readers: DataFrame, unit: str, keep: Sequence[str]) -> DataFrame:
    """Two profile tables and selected reader columns beside each other."""
    columns = [c for c in keep if c in readers.columns]
    clash = [c for c in second.columns if c in first.columns and c != unit]
    return first.join(second.drop(*clash), unit, "left").join(readers.select(unit, *columns).dropDuplicates([unit]), unit, "left")
