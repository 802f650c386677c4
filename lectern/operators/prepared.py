"""Prepared analysis tables at word, sentence and reader level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions.ids import composite_key


def prepared_words(labelled: DataFrame) -> DataFrame:
    """Modelling rows with their composite keys."""
    return labelled.withColumns(
        {"participant_word_key": composite_key("participant_id", "word_id"), "stimulus_word_key": F.col("word_id")}
    )


def _rate(flag: str, name: str):
    return F.avg(F.col(flag).cast("int")).alias(name)


def sentence_quality(labelled: DataFrame) -> DataFrame:
    """Quality rates per sentence, to be joined to the sentence table."""
    return labelled.groupBy("sentence_id").agg(
        F.count("word_id").alias("quality_word_rows"),
        _rate("lm_missing", "lm_missing_rate"),
        _rate("segmentation_label_missing", "segmentation_missing_rate"),
        _rate("embedding_missing", "embedding_missing_rate"),
    )


def reader_exposure(labelled: DataFrame) -> DataFrame:
    """Exposure means and quality rates per reader, to be joined to the reader table."""
    return labelled.groupBy("participant_id").agg(
        F.avg("prev_boundary_opacity_score").alias("mean_segmentation_opacity"),
        F.avg("vv_indicator").alias("vv_boundary_exposure_rate"),
        F.avg("lm_word_surprisal").alias("mean_surprisal"),
        F.avg("lm_word_entropy").alias("mean_entropy"),
        _rate("lm_missing", "lm_missing_rate"),
        _rate("segmentation_label_missing", "segmentation_missing_rate"),
        _rate("embedding_missing", "embedding_missing_rate"),
        _rate("include_primary_analysis", "primary_analysis_row_rate"),
    )
