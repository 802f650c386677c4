"""Chunked ordered operators against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import sequence


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 30, 3000).astype(str)), "v": rng.integers(0, 50, 3000).astype(float)})
    frame["o"] = frame.groupby("k").cumcount() * 3
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("size", [1, 7, 100, None])
def test_chunked_equals_plain(skewed, size):
    frame, df = skewed
    chunk = None if size is None else sequence.by_rows("o", size)
    got = sequence.ordered_features(
        df, ["k"], ["o"], chunk=chunk, index="i", size="n", running={"before": F.col("v")}, totals={"all": F.col("v")},
        previous={"prev": "v"}, following={"next": "v"},
    ).toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    want = frame.sort_values(["k", "o"]).reset_index(drop=True)
    groups = want.groupby("k")
    assert (got.i == groups.cumcount()).all()
    assert (got.n == groups.v.transform("size")).all()
    assert (got.before == groups.v.cumsum() - want.v).all()
    assert (got["all"] == groups.v.transform("sum")).all()
    assert got.prev.fillna(-1).equals(groups.v.shift(1).fillna(-1).rename("prev"))
    assert got.next.fillna(-1).equals(groups.v.shift(-1).fillna(-1).rename("next"))


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5), ("a", 2, None)], "k string, o int, v int")
    rows = sequence.ordered_features(df, ["k"], ["o"], chunk=sequence.by_rows("o", 1), previous={"p": "v"}).orderBy("o").collect()
    assert [r.p for r in rows] == [None, None, 5]


@pytest.mark.parametrize("bars", [1, 4, 64])
def test_exact_quantiles(skewed, bars):
    frame, df = skewed
    got = sequence.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}, bars).toPandas().set_index("k").sort_index()
    want = frame.groupby("k").v.quantile([0.1, 0.5, 0.9]).unstack()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_quantiles_with_an_outlier(spark):
    values = [float(v) for v in range(101)] + [1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = sequence.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.25}).first()
    assert row.m == 50.5 and row.q == 25.25


def test_quantiles_without_keys_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert sequence.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 2.5


def test_chunks_keep_null_keys_and_order_values(spark):
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 5, 3.0), (None, None, 4.0), ("a", 70, 5.0)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    options = {"index": "i", "size": "n", "running": {"before": "v"}}
    plain = sequence.ordered_features(df, ["k"], ["o"], **options)
    chunked = sequence.ordered_features(df, ["k"], ["o"], chunk=F.floor(F.col("o") / 10), **options)
    order = lambda d: sorted((tuple(r[c] for c in plain.columns) for r in d.collect()), key=repr)
    assert order(chunked) == order(plain) and chunked.count() == 5


def test_sampled_chunks_follow_the_order(spark):
    df = spark.createDataFrame([(f"reader{i:05d}",) for i in range(2000)] + [(None,)], "k string")
    rows = sorted(((r["k"] or "", r["c"]) for r in sequence.sampled_chunks(df, "k", "c", cuts=63).collect()))
    chunks = [c for _, c in rows]
    assert chunks == sorted(chunks) and len(set(chunks)) == 64
