"""Contracts must fail when they are broken."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment, contracts, joins, participants, splits


def pairs(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")


def test_many_to_one_rejects_repeated_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(left, pairs(spark), ["k"]).collect()
    ok = joins.many_to_one(left, pairs(spark).where("v > 1"), ["k"])
    assert {(r.k, r.v) for r in ok.collect()} == {("a", 2), ("b", 3), ("c", None)}


def test_unique_only_and_duplicates(spark):
    assert [r.v for r in joins.unique_only(pairs(spark), ["k"]).collect()] == [3]
    row = joins.duplicate_key_rows(pairs(spark), ["k"], "d").first()
    assert (row.d_on_repeated_keys, row.d_beyond_first) == (2, 1)


def test_leakage_is_found(spark):
    rows = spark.createDataFrame([("s", 0, "p1", "train"), ("s", 0, "p1", "test"), ("s", 0, "p2", "train")], "split_name string, fold_id int, participant_id string, split_role string")
    assert contracts.group_leakage(rows).first().violations == 1
    named = rows.withColumns({"reader_group": F.lit("typical_control"), "n_word_rows": F.lit(2)})
    row = splits.fold_counts(named).first()
    assert not row.split_valid and row.skip_reason == "participant_overlap_between_train_and_test"


def test_unsafe_feature_sets():
    with pytest.raises(ValueError, match="forbidden"):
        contracts.assert_safe_feature_sets({"g": ["mean_trt", "n_word_rows"]}, contracts.EXPOSURE_COUNTS)
    contracts.assert_safe_feature_sets({"g": ["mean_trt"]}, contracts.EXPOSURE_COUNTS)


def test_small_class_is_an_error(spark):
    readers = spark.createDataFrame([("P01", 1), ("P02", 0), ("P03", 0)], "participant_id string, label int")
    with pytest.raises(Exception, match="too few readers"):
        participants.class_aware_sample(readers, 4, 2).collect()
    with pytest.raises(ValueError):
        participants.class_aware_sample(readers, 1, 1)
    assert {r.participant_id for r in participants.class_aware_sample(readers, 2, 1).collect()} == {"P01", "P02"}


def test_grouped_folds_cover_and_stratify(spark):
    readers = spark.createDataFrame([(f"P{i:02d}", i % 2) for i in range(20)], "participant_id string, label int")
    rows = splits.grouped_folds(readers, "participant_id", "label", 5).toPandas()
    tests = rows[rows.split_role == "test"]
    assert tests.participant_id.value_counts().eq(1).all() and len(tests) == 20
    assert tests.groupby("fold_id").label.sum().eq(2).all()


def test_token_cases(spark):
    words = spark.createDataFrame(
        [("c", 1, "w1", 0, 3, "tak"), ("c", 2, "w2", 4, 6, "om"), ("c", 3, "w3", 7, 12, "gårde")],
        "context_id string, ord int, word_id string, start int, end int, word_form string",
    )
    tokens = spark.createDataFrame(
        [("c", 0, 0, 2), ("c", 1, 2, 5), ("c", 2, 4, 6), ("c", 3, 6, 6), ("c", 4, 40, 44), ("c", 5, 2, 6)],
        "context_id string, token_ord int, token_start int, token_end int",
    )
    assigned = alignment.align_tokens(tokens, words)
    got = {r.token_ord: r.word_id for r in assigned.collect()}
    assert got == {0: "w1", 1: "w1", 2: "w2", 3: None, 4: None, 5: "w2"}
    texts = spark.createDataFrame([("c", "tak om gårde")], "context_id string, text string")
    row = alignment.validate_alignment(assigned, words, texts).first()
    assert row.status == "error" and row.errors == ["zero_subword_words:1"]
    assert row.warnings == ["non_special_token_unassigned", "token_offset_outside_text"]
    wrong = texts.withColumn("text", F.lit("tak om gaarde"))
    assert "reconstructed_text_mismatch" in alignment.validate_alignment(assigned, words, wrong).first().errors


def test_long_spans_cross_blocks(spark):
    words = spark.createDataFrame([("c", 1, "long", 0, 500), ("c", 2, "next", 501, 510)], "context_id string, ord int, word_id string, start int, end int")
    tokens = spark.createDataFrame([("c", 0, 60, 300), ("c", 1, 300, 509), ("c", 2, 498, 505)], "context_id string, token_ord int, token_start int, token_end int")
    got = {r.token_ord: r.word_id for r in alignment.align_tokens(tokens, words).collect()}
    assert got == {0: "long", 1: "long", 2: "next"}


def test_lineage_store_is_shared(spark):
    from lectern.session import cut_lineage, shared_folder

    stored = cut_lineage(spark.range(5))
    folder = shared_folder(spark).split(":")[-1].lstrip("/")
    assert stored.count() == 5 and folder in stored.inputFiles()[0]


@pytest.mark.parametrize("repeated", [False, True])
def test_compact_counts_equal_counts_of_all_rows(spark, repeated):
    groups = ["dyslexia_labeled", "typical_control", "uncertain", None]
    units = [(f"u{i}", i % 3, groups[i % 4], None if i == 5 else i + 1) for i in range(11)]
    compact = [("plain", 0, "exclude" if g == "uncertain" else "include", u, g, n) for u, f, g, n in units]
    units += [("u0", 1, groups[0], 1)] * repeated  # in two folds
    names = "split_name string, fold_id int, fold_rule string, participant_id string, reader_group string, n_word_rows long"
    full = [("kfold", fold, "test" if f == fold else "train", u, g, n) for u, f, g, n in units for fold in range(3)]
    wanted = splits.fold_counts(spark.createDataFrame(full + compact, names.replace("fold_rule", "split_role")))
    compact += [("kfold", f, "all_but", u, g, n) for u, f, g, n in units]
    compact += [("kfold", None, "all_but", "x", None, 1), ("kfold", 1, "all_but", None, None, 1)]
    found = splits.compact_fold_counts(spark.createDataFrame(compact, names))
    # Classes and rows of a repeated unit count once in the compact form, once a row in the other.
    rows = [c for c in wanted.columns if not repeated or "participants" in c or c in ("split_name", "fold_id", "split_valid", "skip_reason")]
    as_rows = lambda df: sorted(map(tuple, df.select(rows).collect()))
    assert as_rows(found) == as_rows(wanted)
    assert splits.compact_fold_counts(spark.createDataFrame([], names)).count() == 0
