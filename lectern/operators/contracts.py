"""Data-quality contracts as DataFrame checks: (check, violations) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.hashing import md5_int
from lectern.functions.names import EXPOSURE_COUNTS  # noqa: F401


def _named(check: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col("violations").cast("long").alias("violations"))


def schema_gaps(spark: SparkSession, tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Required columns a table lacks, with the table's rows (null when the table itself is missing)."""
    from lectern.operators.reports import table_summary

    rows = [(t, c) for t, columns in required.items() for c in columns if t not in tables or c not in tables[t].columns]
    gaps = spark.createDataFrame(rows, "table_name string, missing_column string")
    known = {t: tables[t] for t, _ in rows if t in tables}
    if not known:
        return gaps.withColumn("rows", F.lit(None).cast("long"))
    return gaps.join(table_summary(known), "table_name", "left")


def unique_key(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """Keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _named(check, repeated.agg(F.count_if(F.col("n") > 1).alias("violations")))


def not_null(df: DataFrame, columns: Sequence[str], check: str) -> DataFrame:
    """Nulls over the listed columns; one aggregation."""
    total = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return _named(check, df.agg(total.alias("violations")))


def closed_domain(df: DataFrame, column: str, allowed: Sequence[str], check: str) -> DataFrame:
    """Rows whose value lies outside the allowed set; null counts as outside."""
    inside = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return _named(check, df.agg(F.count_if(~inside).alias("violations")))


def values_outside(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Distinct values of a column that a reference column lacks."""
    return df.select(column).distinct().exceptAll(allowed.select(F.col(allowed.columns[0]).alias(column)).distinct())


def expected_counts(counts: DataFrame, expected: Mapping[str, int], name: str = "item", value: str = "n") -> DataFrame:
    """Observed beside expected counts of named items."""
    ladder = F.lit(None).cast("long")
    for item, n in expected.items():
        ladder = F.when(F.col(name) == item, F.lit(n).cast("long")).otherwise(ladder)
    compared = counts.withColumn("expected", ladder)
    return compared.withColumn("matches", F.coalesce(F.col(value) == F.col("expected"), F.lit(False)))


def group_leakage(splits: DataFrame, key: str = "participant_id", check: str = "group_leakage") -> DataFrame:
    """(split, fold, unit) present in train and in test."""
    roles = splits.groupBy("split_name", "fold_id", key).agg(
        F.max((F.col("split_role") == "train").cast("int")).alias("tr"), F.max((F.col("split_role") == "test").cast("int")).alias("te")
    )
    return _named(check, roles.agg(F.count_if((F.col("tr") == 1) & (F.col("te") == 1)).alias("violations")))


def no_random_splits(splits: DataFrame, check: str = "random_split_name") -> DataFrame:
    return _named(check, splits.agg(F.count_if(F.col("split_name").rlike("(?i)random")).alias("violations")))


def tested_once(splits: DataFrame, split_name: str, key: str = "participant_id", check: str = "tested_once") -> DataFrame:
    """Units not tested exactly once in a split."""
    tests = splits.where(F.col("split_name") == split_name).groupBy(key).agg(F.count_if(F.col("split_role") == "test").alias("n"))
    return _named(check, tests.agg(F.count_if(F.col("n") != 1).alias("violations")))


def one_test_per_fold(splits: DataFrame, split_name: str, check: str = "one_test_per_fold") -> DataFrame:
    tests = splits.where(F.col("split_name") == split_name).groupBy("fold_id").agg(F.count_if(F.col("split_role") == "test").alias("n"))
    return _named(check, tests.agg(F.count_if(F.col("n") != 1).alias("violations")))


def compact_split_checks(folds: DataFrame, once: str, one_each: str, key: str = "participant_id") -> DataFrame:
    """The four checks above from compact folds (``splits.compact_folds``): a row a unit and split, not a row a unit and fold.

    A unit under several folds is tested in each and trained on in each; a named split of n units
    and m folds stands for n x m rows.
    """
    tested = F.col("fold_rule") == "all_but"
    units = folds.groupBy("split_name", key).agg(F.count_if(tested).alias("n"), F.countDistinct(F.when(tested, F.col("fold_id"))).alias("m"))
    leaks = units.agg(F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("violations"))
    random = folds.where(F.col("split_name").rlike("(?i)random")).groupBy("split_name").agg(
        F.when(F.bool_and(tested), F.countDistinct(key) * F.countDistinct("fold_id")).otherwise(F.count(F.lit(1))).alias("n")
    )
    not_once = units.where(F.col("split_name") == once).agg(F.count_if(F.col("n") != 1).alias("violations"))
    per_fold = folds.where(F.col("split_name") == one_each).groupBy("fold_id").agg(F.count_if(tested).alias("n"))
    return suite(
        _named("group_leakage", leaks),
        _named("random_split_name", random.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))),
        _named("tested_once", not_once),
        _named("one_test_per_fold", per_fold.agg(F.count_if(F.col("n") != 1).alias("violations"))),
    )


def above_limit(report: DataFrame, limits: Mapping[str, float], check: str = "limit") -> DataFrame:
    """One row per limited column of a one-row report; a violation when the value exceeds its limit."""
    items = [
        F.struct(F.lit(f"{check}:{c}").alias("check"), F.coalesce((F.col(c) > limit), F.lit(False)).cast("long").alias("violations"))
        for c, limit in limits.items()
    ]
    return report.select(F.explode(F.array(*items)).alias("i")).select("i.*")


def leakage_columns(feature_sets: Mapping[str, Sequence[str]], forbidden: Sequence[str]) -> dict[str, list[str]]:
    """Forbidden columns per feature set; empty when all sets are safe."""
    banned = set(forbidden)
    found = {name: sorted(set(columns) & banned) for name, columns in feature_sets.items()}
    return {name: columns for name, columns in found.items() if columns}


def assert_safe_feature_sets(feature_sets: Mapping[str, Sequence[str]], forbidden: Sequence[str]) -> None:
    found = leakage_columns(feature_sets, forbidden)
    if found:
        raise ValueError(f"feature sets hold forbidden columns: {found}")


# Columns that must never be predictors.
LEAKAGE_COLUMNS = ("reader_group", "reader_group_binary", "dyslexia_labeled", "group_label", "participant_id", "label")


def within_tolerance(observed: Column, locked: Column, tolerance: float) -> Column:
    """A locked metric is reproduced."""
    return F.coalesce(F.abs(observed - locked) <= tolerance, F.lit(False))


def same_members(left: DataFrame, right: DataFrame, key: str, check: str = "same_members") -> DataFrame:
    """Keys on one side only."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return _named(check, sides.agg(F.count_if(F.col("l") != F.col("r")).alias("violations")))


def suite(*checks: DataFrame) -> DataFrame:
    """All checks as one report with a verdict each."""
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report.withColumn("passed", F.col("violations") == 0)


def verdict(report: DataFrame, good: str = "ready_with_caveats", bad: str = "not_ready") -> DataFrame:
    """One-row judgement over a report."""
    return report.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
        F.when(F.bool_and("passed"), good).otherwise(bad).alias("judgement"),
    )


def lm_feature_contract(scores: DataFrame, keys: Sequence[str] = ("word_id",), statuses: Sequence[str] = ("ok", "warning", "error")) -> DataFrame:
    """Unique and non-null word ids, subword counts above zero, known alignment statuses."""
    few = scores.agg(F.count_if(F.coalesce("lm_subword_count", F.lit(0)) <= 0).alias("violations"))
    return suite(
        unique_key(scores, keys, "lm_unique_word"),
        not_null(scores, list(keys), "lm_word_id_not_null"),
        _named("lm_subwords_positive", few),
        closed_domain(scores, "lm_alignment_status", statuses, "lm_status_domain"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive content fingerprint: row count and sum of row hashes."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(md5_int(*parts)), F.lit(0)).alias("content_hash"))
