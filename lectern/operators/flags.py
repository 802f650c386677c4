"""Row-level quality labels of the modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def all_null(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNull()
    return test


def any_null(columns: Sequence[str]) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull()
    return test


FLAGS = (
    "gaze_missing", "participant_label_missing", "segmentation_label_missing", "lm_missing", "parser_missing",
    "embedding_missing", "participant_metadata_missing",
)


def quality_labels(df: DataFrame, group: str = "reader_group", segmentation: str = "segmentation_label_version") -> DataFrame:
    """Missingness flags, inclusion predicates and the reason a row is left out."""
    flagged = df.withColumns(
        {
            "gaze_missing": all_null(["TRT", "FFD", "GD"]),
            "participant_label_missing": F.col(group).isNull(),
            "segmentation_label_missing": F.col(segmentation).isNull(),
            "lm_missing": F.col("lm_word_surprisal").isNull(),
            "parser_missing": F.col("upos").isNull(),
            "parser_status": F.lit("surface_heuristic_fallback"),
            "embedding_missing": all_null(["paragraph_cohesion", "local_semantic_drift"]),
            "participant_metadata_missing": any_null(["age", "sex", "comprehension_score"]),
        }
    )
    primary = F.coalesce("include_primary_analysis", F.lit(False))
    sensitivity = F.coalesce("include_sensitivity_analysis", F.lit(False))
    no_label, no_boundary = F.col("participant_label_missing"), F.col("segmentation_label_missing")
    return flagged.withColumns(
        {
            "include_primary_analysis": primary & ~no_label & ~no_boundary,
            "include_sensitivity_analysis": sensitivity & ~no_label,
            "exclusion_reason": F.concat_ws(
                ";", F.when(no_label, "participant_label_missing"), F.when(no_boundary, "segmentation_label_missing")
            ),
        }
    )
