"""Observation panels: measures, duplicate collapse, per-reader aggregates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import log1p_positive, refixations, skip_flag, slope, to_number
from lectern.operators.joins import dealt
from lectern.operators.sequence import exact_quantiles, unpivot_values

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def map_measures(df: DataFrame, mapping: Mapping[str, str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """Source columns to canonical measures; a source that is absent gives nulls."""
    wanted = {**mapping, **(optional or {})}
    none = F.lit(None).cast("double")
    out = df.withColumns({target: to_number(src) if src in df.columns else none for target, src in wanted.items()})
    if "fixation_count" in wanted:
        out = out.withColumns({"skip": skip_flag("fixation_count"), "refixation_count": refixations("fixation_count")})
    return out


def collapse_duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, first: Sequence[str] = (), drop: Sequence[str] = (),
    flags: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """One row per key: numbers averaged, other columns (and ``first``) the first non-null in order.

    ``flags`` are averaged and rounded half-even. All aggregates combine map-side, so repeated keys
    shrink before the shuffle; with ``parts``, keys that hardly repeat are dealt over so many tasks instead.
    """
    rank = F.struct(*order)
    aggs = []
    for name, kind in df.dtypes:
        if name in keys or name in drop:
            continue
        value = F.col(name)
        if name in flags:
            aggs.append(F.bround(F.avg(value.cast("double"))).cast("int").alias(name))
        elif kind in NUMERIC and name not in first:
            aggs.append(F.avg(value.cast("double")).alias(name))
        else:
            aggs.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(name))
    return dealt(df, keys, parts).groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("source_observation_count"))


def add_derived_columns(df: DataFrame, label: str = "label") -> DataFrame:
    """Numeric label, vowel-vowel indicator, fixated flag, logs of positive durations."""
    logs = {"log_ffd": "FFD", "log_first_pass_duration": "GD", "log_go_past_time": "go_past_time", "log_total_fixation_duration": "TRT"}
    skip = F.least(F.greatest(F.coalesce(F.col("skip").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.withColumns(
        {
            "label_num": F.col(label).cast("double"),
            "vv_indicator": F.coalesce(F.col("prev_boundary_type_orth") == "V#V", F.lit(False)).cast("int"),
            "fixated": 1.0 - skip,
            **{new: log1p_positive(src) for new, src in logs.items() if src in df.columns},
            "log_fixation_count": F.log1p(F.col("fixation_count")),
        }
    )


def reader_means(df: DataFrame, by: str = "participant_id", label: str = "label") -> DataFrame:
    """Means, rates, spread and TRT slopes of each reader: one algebraic aggregation."""
    return df.groupBy(by).agg(
        F.max(label).alias("label"),
        F.avg("FFD").alias("mean_ffd"),
        F.avg("GD").alias("mean_gd"),
        F.avg("TRT").alias("mean_trt"),
        F.avg("skip").alias("skipping_rate"),
        F.avg("refixation_count").alias("refixation_rate"),
        F.avg("go_past_time").alias("mean_go_past_time"),
        F.stddev_samp("TRT").alias("trt_sd"),
        F.count("word_id").alias("word_observation_count"),
        slope(F.col("TRT"), F.col("word_length_chars")).alias("length_sensitivity"),
        slope(F.col("TRT"), F.col("log_corpus_frequency")).alias("frequency_sensitivity"),
        slope(F.col("TRT"), F.col("lm_word_surprisal")).alias("surprisal_sensitivity"),
        slope(F.col("TRT"), F.col("lm_word_entropy")).alias("entropy_sensitivity"),
    )


def reader_aggregates(df: DataFrame, by: str = "participant_id", label: str = "label") -> DataFrame:
    """``reader_means`` beside the exact medians and upper decile of the durations, which share one pass in long form."""
    base = reader_means(df, by, label)
    long = unpivot_values(df, [by], ["FFD", "GD", "TRT"], "measure", "value")
    found = exact_quantiles(long, [by, "measure"], "value", {"median": 0.5, "q90": 0.9})
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    wide = found.groupBy(by).agg(
        pick("FFD", "median").alias("median_ffd"), pick("GD", "median").alias("median_gd"),
        pick("TRT", "median").alias("median_trt"), pick("TRT", "q90").alias("trt_q90"),
    )
    return base.join(wide, by, "left")


def group_slopes(df: DataFrame, by: str, outcome: str, predictors: Sequence[str], minimum: int) -> DataFrame:
    """OLS slope of the outcome on each predictor per group, null below ``minimum`` pairs."""
    return df.groupBy(by).agg(
        *[slope(F.col(outcome), F.col(p), minimum).alias(f"{p}_slope") for p in predictors]
    )


# Feature families by name.
FAMILIES = {
    "gaze": ["FFD", "GD", "TRT", "fixation_count", "skip", "refixation_count", "go_past_time"],
    "classical_linguistic": [
        "word_length_chars", "syllable_count", "word_index_in_sentence", "word_index_in_paragraph",
        "word_position_in_sentence_norm", "word_position_in_paragraph_norm", "sentence_length_words", "paragraph_length_words",
    ],
    "parser_morphosyntax": [
        "is_function_word", "is_noun_or_proper", "is_pronoun", "is_finite_verb", "is_negation", "dependency_distance",
    ],
}
FAMILY_PATTERNS = {
    "lm_surprisal_entropy": r"surprisal|entropy",
    "embeddings": r"^embedding_|cohesion|centroid|semantic_drift",
    "instruct_annotations": r"^(instruct|annotation)_",
}


def family_columns(df: DataFrame, families: Sequence[str]) -> list[str]:
    """Columns of ``df`` that belong to the families, by fixed list or name pattern, without repeats."""
    chosen: list[str] = []
    for family in families:
        chosen += [c for c in FAMILIES.get(family, []) if c in df.columns]
        pattern = FAMILY_PATTERNS.get(family)
        chosen += [c for c in df.columns if pattern and re.search(pattern, c)]
    return list(dict.fromkeys(chosen))


def wide_mean_sd(df: DataFrame, by: Sequence[str], columns: Sequence[str], label: str = "label") -> DataFrame:
    """Mean and sample SD of every feature per key, with the key's label: one aggregation."""
    aggs: list[Column] = []
    for c in columns:
        value = F.col(c).cast("double")
        aggs += [F.avg(value).alias(f"{c}__mean"), F.stddev_samp(value).alias(f"{c}__sd")]
    return df.groupBy(*by).agg(*aggs, F.max(label).cast("int").alias(label))
