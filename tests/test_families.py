"""The family fold against chained joins, and its contracts."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import families, joins
from lectern.plans import corpus_features

KEYS = ["t", "w"]


def base(spark):
    return spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("c", 9, "z")], "t string, w int, form string")


def sides(spark):
    one = spark.createDataFrame([("a", 1, 0.5), ("b", 1, None), ("zz", 7, 2.0)], "t string, w int, score double")
    two = spark.createDataFrame([("a", 2, [1, 2], "k"), (None, 1, [3], "n"), ("c", 9, None, "q")], "t string, w int, v array<int>, tag string")
    return {"one": one, "two": two, "none": spark.createDataFrame([], "t string, w int, u int")}


def test_equals_chained_left_joins(spark):
    want = base(spark)
    for name, df in sides(spark).items():
        want = joins.many_to_one(want, df.withColumn(f"n_{name}", F.lit(1)), KEYS)
        want = want.withColumn(f"missing_{name}", F.col(f"n_{name}").isNull()).drop(f"n_{name}")
    got = families.fold_families(base(spark), sides(spark), KEYS)
    assert set(got.columns) == set(want.columns)
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    again = families.fold_families(base(spark), sides(spark), KEYS, partition_by=["t"])
    assert sorted(again.collect(), key=str) == sorted(got.collect(), key=str)


def test_a_row_of_nulls_is_not_missing(spark):
    rows = {r.t: r for r in families.fold_families(base(spark), sides(spark), KEYS).where("w = 1").collect()}
    assert rows["b"].score is None and not rows["b"].missing_one and rows["b"].missing_two


def test_contracts(spark):
    twice = {"one": spark.createDataFrame([("a", 1, 1), ("a", 1, 1)], "t string, w int, score int")}
    with pytest.raises(Exception, match="one: key .* is not unique"):
        families.fold_families(base(spark), twice, KEYS).collect()
    with pytest.raises(Exception, match="base: key .* is not unique"):
        families.fold_families(base(spark).union(base(spark)), {}, KEYS).collect()
    with pytest.raises(Exception, match="base: null in key"):
        families.fold_families(base(spark).withColumn("t", F.lit(None).cast("string")), {}, KEYS).collect()
    with pytest.raises(ValueError, match="taken"):
        families.fold_families(base(spark), {"one": base(spark)}, KEYS)
    with pytest.raises(ValueError, match="base"):
        families.fold_families(base(spark), {"base": base(spark)}, KEYS)
    units = spark.createDataFrame([("a", 1), ("a", 2)], "t string, u int")
    with pytest.raises(Exception, match="unit: key"):
        families.attach_unit(base(spark), units, "unit", ["t"]).collect()


def test_no_rows(spark):
    empty = base(spark).limit(0)
    assert families.fold_families(empty, sides(spark), KEYS).count() == 0
    report = families.missing_rates(families.fold_families(empty, sides(spark), KEYS), empty).collect()
    assert {(r.base_rows, r.joined_rows, r.missing_rows, r.missing_rate) for r in report} == {(0, 0, 0, None)}


def test_words_are_placed_once(spark):
    """One exchange places the words; the paragraph join and the sentence table add none over them."""
    texts = spark.createDataFrame([(1, "A cat sat. A cat ran!\nOne only"), (2, ""), (3, None)], "doc_id long, text string")
    words = corpus_features.corpus_words(texts)
    plan = corpus_features.prepared_sentences(corpus_features.word_features(texts, words))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(text_id") - plan.count("REPARTITION_BY_COL") <= 1  # the other one: paragraph units
    rows = corpus_features.word_features(texts, words).collect()
    assert len(rows) == 8
    assert {r.p for r in rows if not r.missing_embedding} == {1}
    assert all(r.missing_lm == (r.w == 1) for r in rows)
