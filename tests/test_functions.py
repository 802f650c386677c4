"""Single-operator cases with literal inputs."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import ids, numeric, orthography, tokens


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression).collect()]


def test_participant_ids(spark):
    got = column(spark, ["p1", "001", "P01", "12.0", "p100", "xy", None, ' "7" '], ids.normalize_participant("v"))
    assert got == ["P01", "P01", "P01", "P12", "P100", "XY", "", "P07"]


def test_clean_tokens(spark):
    assert column(spark, ["12.0", "-3.0", "1.5", None, ' "a" '], ids.clean_token("v")) == ["12", "-3", "1.5", "", "a"]


def test_stable_ids(spark):
    df = spark.createDataFrame([("45", "2", "1", "3", "p1")], "t string, p string, s string, w string, r string")
    row = ids.with_stable_ids(df, "t", "p", "s", "w", "r").first()
    assert (row.word_id, row.paragraph_id, row.participant_id) == ("45_p2_s1_w3", "45_p2", "P01")
    with pytest.raises(ValueError, match="lacks columns"):
        ids.with_stable_ids(df, "t", "p", "s", "missing")


def test_labels(spark):
    assert column(spark, ["1.0", "Yes", "control", "0", "?", None], ids.parse_label("v")) == [1, 1, 0, 0, None, None]


def test_numbers(spark):
    assert column(spark, ["1.5", "12d", "NaN", "x", None, " 2 ", "1e3"], numeric.to_number("v")) == [1.5, None, None, None, None, 2.0, 1000.0]
    assert column(spark, ["1,5", "2.5"], numeric.to_number_decimal_comma("v")) == [1.5, 2.5]


def test_syllables(spark):
    assert column(spark, ["hus", "læsning", "psst", "", None], tokens.syllables("v")) == [1, 2, 1, 0, 0]


def test_pos_ladder(spark):
    got = column(spark, ["på", "og", "ikke", "aldrig", "arbejdede", "Anna", "hus"], tokens.heuristic_pos("v"))
    assert got == ["ADP", "SCONJ", "SCONJ", "PART", "VERB", "PROPN", "NOUN"]


@pytest.mark.parametrize(
    "previous, word, initial, kind",
    [("tak", "for", False, "C#C"), ("tak", "om", False, "C#V"), ("de", "går", False, "V#C"), ("se", "efter", False, "V#V"),
     (None, "efter", True, "unknown"), ("", "efter", False, "unknown"), ("12", "om", False, "unknown")],
)
def test_boundaries(spark, previous, word, initial, kind):
    df = spark.createDataFrame([(previous, word, initial)], "p string, w string, i boolean")
    row = orthography.add_boundary_columns(df, "p", "w", "i").first()
    assert row.orth_boundary_type == kind
    if kind == "V#V":
        assert row.vocoid_run_cross_boundary == 2 and row.boundary_opacity_score == 3 and row.boundary_opacity_class == "high"


def test_vowel_runs_and_stripping(spark):
    got = column(spark, ["Åben!", "saaeed", "123"], orthography.strip_non_letters("v"))
    assert got == ["Åben", "saaeed", ""]
    assert column(spark, ["saaeed", ""], orthography.longest_vowel_run(F.col("v"))) == [4, 0]
    assert column(spark, ["a", "t", "-", "", None], orthography.letter_class("v")) == ["V", "C", "other", "unknown", "unknown"]


def test_bins_are_right_closed(spark):
    labels = numeric.interval_labels([0.0, 5.0, 10.0])
    assert column(spark, [0.0, 5.0, 5.1, 10.0, 11.0, None], numeric.right_closed_bin("v", [0.0, 5.0, 10.0], labels), "double") == ["(0, 5]", "(0, 5]", "(5, 10]", "(5, 10]", None, None]


def test_signal_ladder(spark):
    df = spark.createDataFrame([(0.8, 0.01), (0.8, 0.5), (0.66, None), (0.5, 0.0), (None, 0.0)], "v double, p double")
    got = [r[0] for r in df.select(numeric.threshold_category(F.col("v"), 0.75, 0.65, 0.55, F.col("p"))).collect()]
    assert got == ["strong_signal", "weak_signal", "promising_signal", "not_supported", "blocked_by_data_quality"]


def test_correlation_of_constant_side_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    row = df.agg(numeric.pearson(F.col("x"), F.col("y")).alias("r"), numeric.slope(F.col("y"), F.col("x")).alias("b")).first()
    assert row.r is None and row.b is None


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r[0] for r in numeric.nan_to_null(df).collect()] == [None, 1.0]


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(numeric.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None]


def test_measures_are_read_from_declared_names():
    from lectern.functions import names

    assert names.measure_of("mean_trt").units == "ms" and names.statistics_of("trt_q90") == ["upper decile"]
    assert names.measure_of("word_id") is names.KEY and names.measure_of("colour") is names.UNDECLARED
    assert names.family_of("crossfit_trt_mean") == "residual_gaze" and names.family_of("total_word_rows") == "exposure_count"


def test_centroids_use_all_coordinates(spark):
    from lectern.operators import vectors

    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("a", [3.0, 2.0, 1.0, 0.0])], "u string, v array<double>")
    assert vectors.centroids(df, "u", "v").first()["centroid"] == [2.0, 2.0, 2.0, 2.0]
