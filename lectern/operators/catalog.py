"""Column catalogue and reader feature groups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern.functions import names
from lectern.operators.contracts import LEAKAGE_COLUMNS

TYPES = {"boolean": "boolean", "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer",
         "double": "numeric", "float": "numeric", "timestamp": "datetime", "date": "datetime"}


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """(table, column, type, rows, missing) of every column, in one aggregation."""
    items = [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(c).alias("feature_name"), F.lit(TYPES.get(t, "string")).alias("type"),
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing"),
        )
        for c, t in df.dtypes
    ]
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def catalogue(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Meaning of every column of every table: level, units, transform, direction, policy, permitted use.

    ``tables`` maps a name to the frame and its level (word, sentence, reader ...).
    """
    return reduce(DataFrame.unionByName, [described(df, name, level) for name, (df, level) in tables.items()])


def described(df: DataFrame, table: str, level: str) -> DataFrame:
    """One table's columns with what their measures declare."""
    facts = []
    for c in df.columns:
        m = names.measure_of(c)
        label = m is names.KEY or c in LEAKAGE_COLUMNS or dict(df.dtypes)[c] == "string"
        reader = level == "reader" or c in LEAKAGE_COLUMNS
        facts.append((c, m.units, ", ".join(names.statistics_of(c)) or "none", m.missing, m.reading, reader, not label, m is not names.KEY))
    fields = ("units", "transformation", "missing_value_policy", "expected_direction", "participant_specific", "allowed_in_predictive_models", "allowed_in_mixed_effects")
    known = F.create_map(*[x for f in facts for x in (F.lit(f[0]), F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, f[1:])]))])
    rows = column_profile(df, table).withColumns({"level": F.lit(level), "__facts": known[F.col("feature_name")]})
    return rows.select("*", "__facts.*").drop("__facts")


def reader_feature_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    """Feature groups of a reader profile table by name rules, limited to the columns at hand."""
    def like(pattern: str) -> list[str]:
        return [c for c in columns if re.search(pattern, c)]

    crossfit = like(r"^crossfit_")
    groups = {
        "raw_gaze": [c for c in names.RAW_GAZE if c in columns],
        "residual_gaze": [c for c in crossfit if re.search(r"_(mean|median|sd)$", c)],
        "sensitivity_slopes": like(r"_sensitivity$|_slope$"),
        "predictability_exposure": like(r"^mean_(surprisal|entropy)_exposure$|^lm_missing_rate$"),
        "predictability_sensitivity": like(r"(surprisal|entropy)_(sensitivity|slope)$"),
        "predictability_residual": [c for c in crossfit if re.search(r"(surprisal|entropy)_slope$", c)],
        "segmentation_exposure": like(r"^mean_boundary_opacity_exposure$|^vv_boundary_exposure_rate$"),
        "segmentation_sensitivity": like(r"boundary_opacity_(sensitivity|slope)$|_high_opacity_cost$|_vv_cost$"),
    }
    everything = list(dict.fromkeys([c for cols in groups.values() for c in cols] + like(r"^(age|comprehension_score)$")))
    without = lambda pattern: [c for c in everything if not re.search(pattern, c)]
    groups["all_but_exposure"] = [c for c in everything if not names.is_text_exposure(c)]
    groups["all_but_predictability"] = without(r"surprisal|entropy|^lm_")
    groups["all_but_segmentation"] = without(r"boundary|opacity|vv_")
    groups["all_but_raw_speed"] = [c for c in everything if c not in names.GLOBAL_SPEED]
    return groups


PRIMARY_GROUPS = (
    "residual_gaze", "sensitivity_slopes", "predictability_sensitivity", "predictability_residual", "segmentation_sensitivity",
    "all_but_exposure", "all_but_raw_speed",
)


def feature_group_metadata(profiles: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (group, feature): family, exposure flag, permission, and how complete the feature is."""
    held = column_profile(profiles, "profiles").select("feature_name", "rows", "missing")
    items = F.array_compact(F.array(*[F.when(F.col("feature_name").isin(*cols), g) for g, cols in groups.items() if cols]))
    rows = held.withColumn("feature_group", F.explode(items))
    name = F.col("feature_name")
    exposure = name.isin(*names.EXPOSURE_COUNTS) | F.array_contains(F.split(name, "_"), "exposure") | F.array_contains(F.split(name, "_"), "missing")
    return rows.withColumns(
        {
            "feature_family": names.feature_family(name, profiles.columns),
            "could_encode_text_assignment": exposure,
            "allowed_in_primary_model": F.col("feature_group").isin(*PRIMARY_GROUPS) & ~exposure & ~name.isin(*LEAKAGE_COLUMNS),
        }
    )


def feature_group_summary(metadata: DataFrame) -> DataFrame:
    """Features, exposure and permitted counts per group."""
    return metadata.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.bool_or("could_encode_text_assignment").alias("any_exposure"),
        F.count_if("allowed_in_primary_model").alias("n_allowed"),
    )
