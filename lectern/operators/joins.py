"""Joins that state and enforce their key contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import ratio


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first whole row of each key. An ordered minimum combines map-side, so no key is gathered."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*_cols(order))).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*df.columns)


def _one_row_per_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__k"), *rest)).alias("__row"))
    return packed, rest


def unique_only(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once (duplicated keys drop out entirely)."""
    packed, rest = _one_row_per_key(df, keys)
    return packed.where("__n = 1").select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def asserting_unique(df: DataFrame, keys: Sequence[str], what: str = "right side") -> DataFrame:
    """The same rows, failing at run time when a key repeats. Lazy: no extra job."""
    packed, rest = _one_row_per_key(df, keys)
    message = f"{what}: key ({', '.join(keys)}) is not unique"
    checked = packed.where(F.assert_true(F.col("__n") == 1, message).isNull())
    return checked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def dealt(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` by keys over ``parts`` tasks, which joins and aggregates on these keys then keep; none: as Spark deals them."""
    return df.repartition(parts, *keys) if parts else df


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "right side", parts: int | None = None) -> DataFrame:
    """Left join that never multiplies rows: a repeated right key is an error. A join by shuffle is made in ``parts`` tasks."""
    return left.join(asserting_unique(dealt(right, keys, parts), keys, what), list(keys), "left")


def many_to_first(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Left join to the first right row per key."""
    return left.join(first_per_key(right, keys, order), list(keys), "left")


def inner_on_unique_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join over keys that are unique on both sides."""
    return unique_only(left, keys).join(unique_only(right, keys), list(keys))


def duplicate_key_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: rows that sit on a repeated key, and rows beyond the first per key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(f"{name}_on_repeated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"{name}_beyond_first"),
    )


def finest_key(right: DataFrame, candidates: Sequence[str]) -> str:
    for key in candidates:
        if key in right.columns:
            return key
    raise ValueError(f"right side has none of {list(candidates)}")


def join_at_finest_key(left: DataFrame, right: DataFrame, candidates: Sequence[str], suffix: str = "_extra") -> DataFrame:
    """Left join on the finest key the right side carries; colliding names get a suffix."""
    key = finest_key(right, candidates)
    names = {c: c if c == key or c not in left.columns else c + suffix for c in right.columns}
    renamed = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    return left.join(renamed, key, "left")


def join_and_coalesce(
    left: DataFrame, right: DataFrame, keys: Sequence[str], prefer: str = "left"
) -> DataFrame:
    """Left join; columns on both sides merge into one, the preferred side first."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in right.columns])
    joined = left.join(renamed, list(keys), "left")
    merged = {
        c: F.coalesce(*([F.col(c), F.col(f"__r_{c}")] if prefer == "left" else [F.col(f"__r_{c}"), F.col(c)]))
        for c in shared
    }
    return joined.withColumns(merged).drop(*[f"__r_{c}" for c in shared])


def join_report(
    base: DataFrame, joined: DataFrame, keys: Sequence[str], families: Mapping[str, Column]
) -> DataFrame:
    """One row: rows before and after, loss, gain, duplicated keys, missing rate per family."""
    before = base.agg(F.count(F.lit(1)).alias("base_rows")).withColumn("one", F.lit(1))
    per_key = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c.isNull()).alias(f"__m_{k}") for k, c in families.items()]
    )
    after = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
        *[F.sum(f"__m_{k}").alias(f"__m_{k}") for k in families],
    ).withColumn("one", F.lit(1))
    both = before.join(after, "one")
    return both.select(
        "base_rows",
        "joined_rows",
        F.greatest(F.col("base_rows") - F.col("joined_rows"), F.lit(0)).alias("row_loss"),
        F.greatest(F.col("joined_rows") - F.col("base_rows"), F.lit(0)).alias("row_gain"),
        "duplicate_keys",
        *[ratio(F.col(f"__m_{k}"), F.col("joined_rows")).alias(f"missing_{k}_rate") for k in families],
    )


def cross_check(
    left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], tolerance: float = 1e-6
) -> DataFrame:
    """Per metric: rows compared, matches within the tolerance, largest difference.

    ``metrics`` maps a left column to the right column it must equal; keys that
    repeat on either side are left out.
    """
    a = left.select(*keys, *[F.col(m).cast("double").alias(f"l_{m}") for m in metrics])
    b = right.select(*keys, *[F.col(r).cast("double").alias(f"r_{m}") for m, r in metrics.items()])
    matched = inner_on_unique_keys(a, b, keys)
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"l_{m}") - F.col(f"r_{m}")).alias("diff")) for m in metrics]
        )
    )
    return (
        matched.select(pairs.alias("m"))
        .groupBy("m.metric")
        .agg(
            F.count("m.diff").alias("compared_rows"),
            F.count_if(F.col("m.diff") <= tolerance).alias("matching_rows"),
            F.max("m.diff").alias("max_abs_diff"),
        )
    )
