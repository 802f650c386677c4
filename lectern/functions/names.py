"""What columns mean: declared measures, and the statistics that column names add to them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# readers' raw gaze features, exposure counts, global speed features.
RAW_GAZE = (
    "mean_ffd", "median_ffd", "mean_gd", "median_gd", "mean_trt", "median_trt", "skipping_rate", "refixation_rate",
    "mean_go_past_time", "trt_sd", "trt_q90",
)
EXPOSURE_COUNTS = ("word_observation_count", "n_speeches", "n_texts", "n_word_rows", "n_words_read", "total_word_rows")
GLOBAL_SPEED = ("mean_ffd", "median_ffd", "mean_gd", "median_gd", "mean_trt", "median_trt", "mean_go_past_time", "trt_sd", "trt_q90")


@dataclass(frozen=True)
class Measure:
    """What is measured, whatever statistic of it a column holds."""

    names: tuple[str, ...]
    units: str
    family: str = "covariate_or_other"
    reading: str = "open"  # what a larger value says about reading
    missing: str = "unknown value"


MEASURES = (
    Measure(("ffd", "gd", "trt", "go_past_time"), "ms", "gaze", "slower", "word was skipped"),
    Measure(("skip", "skipping"), "0 or 1", "gaze", "easier"),
    Measure(("fixation_count", "refixation_count", "refixation"), "count", "gaze", "slower"),
    Measure(("surprisal", "word_surprisal"), "nats", "predictability", "harder", "no model score"),
    Measure(("entropy", "word_entropy"), "nats", "predictability", "harder", "no model score"),
    Measure(("missing",), "share", "predictability"),
    Measure(("boundary_opacity", "boundary_opacity_score", "prev_boundary_opacity_score"), "score", "segmentation", "harder", "no word before"),
    Measure(("vv", "vv_indicator", "vv_boundary", "vocoid_run_cross_boundary"), "0 or 1", "segmentation", "harder", "no word before"),
    Measure(("length", "word_length", "word_length_chars"), "characters", reading="harder"),
    Measure(("sentence_length", "sentence_length_words"), "words", reading="harder"),
    Measure(("frequency", "corpus_frequency"), "tokens", reading="easier", missing="form not in corpus"),
    Measure(("cohesion", "paragraph_cohesion"), "cosine", reading="easier", missing="a single vector"),
    Measure(("drift", "local_semantic_drift"), "cosine distance", reading="harder", missing="a single vector"),
    Measure(("age",), "years"),
    Measure(("comprehension", "comprehension_score"), "score"),
)
BY_NAME = {name: m for m in MEASURES for name in m.names}
UNDECLARED = Measure((), "undeclared")
KEY = Measure((), "identifier", missing="never")

#: Parts of a name that say which statistic, or whose, it is; the rest names the measure.
STATISTICS = {
    "mean": "mean", "median": "median", "sd": "standard deviation", "q90": "upper decile", "rate": "mean",
    "log": "logarithm", "norm": "relative", "sensitivity": "slope", "slope": "slope", "z": "z-score",
}
QUALIFIERS = {"exposure", "lm", "dfm", "crossfit", "residual"}


def statistics_of(column: str) -> list[str]:
    return [STATISTICS[p] for p in column.lower().split("_") if p in STATISTICS]


def measure_of(column: str) -> Measure:
    """The declared measure that a column's name leaves once statistics are taken off."""
    parts = column.lower().split("_")
    if parts[-1] in ("id", "key"):
        return KEY
    left = [p for p in parts if p not in STATISTICS and p not in QUALIFIERS]
    return BY_NAME.get("_".join(left), UNDECLARED)


def is_text_exposure(column: str) -> bool:
    """Whether a column says what a reader was given to read: an ``exposure`` statistic, or a share of words without a score."""
    return "exposure" in column.lower().split("_") or "missing" in measure_of(column).names


def family_of(column: str) -> str:
    """Family of a reader feature: listed ones first, then by measure."""
    if column in EXPOSURE_COUNTS:
        return "exposure_count"
    if is_text_exposure(column):
        return "text_exposure"
    if column in RAW_GAZE:
        return "raw_gaze"
    if "crossfit" in column.split("_") or "residual" in column.split("_"):
        return "residual_gaze"
    family = measure_of(column).family
    return "raw_gaze" if family == "gaze" else family


def feature_family(name: Column | str, columns: Iterable[str]) -> Column:
    """Families of the named columns, looked up by a column of names."""
    pairs = [F.lit(x) for c in columns for x in (c, family_of(c))]
    return F.create_map(*pairs)[F.col(name) if isinstance(name, str) else name]
