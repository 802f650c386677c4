"""Descriptive audits: counts, distributions, group summaries, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import pearson, ratio
from lectern.operators.scalars import with_totals
from lectern.operators.sequence import exact_quantiles, unpivot_values


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and proportion of each value, null as ``missing``. The total comes from the counts."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = counts.agg(F.sum("count").alias("__total"))
    return with_totals(counts, total).select("value", "count", ratio(F.col("count"), F.col("__total")).alias("proportion"))


def correlations(df: DataFrame, pairs: Mapping[str, tuple[str, str]], minimum: int = 3) -> DataFrame:
    """Named pairwise-complete correlations with their n, all from one aggregation."""
    aggs = [F.struct(
        F.lit(name).alias("analysis"),
        F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"),
        pearson(F.col(x), F.col(y), minimum).alias("correlation"),
    ) for name, (x, y) in pairs.items()]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def feature_confounds(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Correlation of each feature with a target and the feature's missing rate."""
    aggs = [F.struct(
        F.lit(f).alias("feature"),
        pearson(F.col(target), F.col(f), 2).alias("correlation"),
        F.avg(F.col(f).isNull().cast("int")).alias("missing_rate"),
    ) for f in features]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def missing_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Missing count and rate per field."""
    aggs = [F.struct(
        F.lit(f).alias("field"), F.count_if(F.col(f).isNull()).alias("missing"), F.avg(F.col(f).isNull().cast("int")).alias("missing_rate")
    ) for f in fields]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def flag_rates(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows and the rate of every flag, overall or per key."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.avg(F.col(f).cast("int")).alias(f"{f}_rate") for f in flags]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def nested_means(df: DataFrame, group: str, unit: str, text: str) -> DataFrame:
    """Per group: units, rows, distinct texts, and the per-unit means of rows and texts.

    Rows shrink to (group, unit, text) cells first; every later step works on those.
    """
    cells = df.groupBy(group, unit, text).agg(F.count(F.lit(1)).alias("n"))
    units = cells.groupBy(group, unit).agg(F.sum("n").alias("n"), F.count(text).alias("texts"))
    per_unit = units.groupBy(F.col(group).alias("__g")).agg(
        F.count(unit).alias("participants"), F.sum("n").alias("word_rows"),
        F.avg("n").alias("mean_words_per_participant"), F.avg("texts").alias("mean_texts_per_participant"),
    )
    texts = cells.select(group, text).distinct().groupBy(group).agg(F.count(text).alias("texts_read"))
    return texts.join(per_unit, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def group_means(df: DataFrame, group: str, means: Sequence[str], rates: Mapping[str, Column] | None = None) -> DataFrame:
    """Means of features and rates of conditions per group."""
    aggs = [F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in means]
    aggs += [F.avg(c.cast("int")).alias(n) for n, c in (rates or {}).items()]
    return df.groupBy(group).agg(*aggs)


def value_distribution_text(df: DataFrame, group: str, unit: str, value: str, name: str) -> DataFrame:
    """``value:count`` list per group over distinct units; a bounded list of category counts, most frequent first."""
    counts = df.select(group, unit, value).distinct().where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(value).cast("string").alias("v"), "n")))
    text = F.array_join(F.transform(items, lambda x: F.concat(x["v"], F.lit(":"), x["n"].cast("string"))), ", ")
    return counts.groupBy(group).agg(text.alias(name))


def exposure_summary(
    df: DataFrame, means: Sequence[str], rates: Mapping[str, Column], group: str = "reader_group",
    unit: str = "participant_id", text: str = "text_id", category: str = "sex",
) -> DataFrame:
    """What each group was exposed to: nested means, feature means, rates, category mix."""
    nested = nested_means(df, group, unit, text).withColumnRenamed(group, "__a")
    mixes = value_distribution_text(df, group, unit, category, f"{category}_distribution").withColumnRenamed(group, "__b")
    out = group_means(df, group, means, rates).join(nested, F.col(group).eqNullSafe(F.col("__a"))).drop("__a")
    return out.join(mixes, F.col(group).eqNullSafe(F.col("__b")), "left").drop("__b")


def text_balance(df: DataFrame, text: str = "text_id", group: str = "reader_group", unit: str = "participant_id") -> DataFrame:
    """Readers and rows per text and group."""
    cells = df.groupBy(text, group, unit).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(text, group).agg(F.count(unit).alias("participant_count"), F.sum("n").alias("word_rows"))


def mean_shift(df: DataFrame, features: Sequence[str], missing: str) -> DataFrame:
    """Feature means over all rows, rows without the flag, and rows with it."""
    flag = F.col(missing)
    aggs = [F.struct(
        F.lit(f).alias("feature"), F.avg(f).alias("mean_all"),
        F.avg(F.when(~flag, F.col(f))).alias("mean_complete"), F.avg(F.when(flag, F.col(f))).alias("mean_missing"),
    ) for f in features]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def describe_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, SD, extremes and exact quartiles per column, from one long pass."""
    long = unpivot_values(df, [], columns, "feature", "value")
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basic.join(exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "feature", "left")


def group_summary(df: DataFrame, group: str, rates: Sequence[str], means: Sequence[str], unit: str = "participant_id") -> DataFrame:
    """Readers, rows, rates and means per group."""
    readers = df.groupBy(F.col(group).alias("__g"), unit).agg(F.count(F.lit(1)).alias("n")).groupBy("__g").agg(
        F.count(unit).alias("participants"), F.sum("n").alias("rows")
    )
    values = df.groupBy(group).agg(
        *[F.avg(r).alias(f"{r}_rate") for r in rates], *[F.avg(m).alias(f"mean_{m.lower()}") for m in means]
    )
    return values.join(readers, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
