"""Shared fits over folds, units left out and dealt labels against one refit each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import fold_fits, learning, splits

FEATURES = ["f", "g", "h"]


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(7)
    n = 31
    frame = pd.DataFrame({"u": [f"P{i:02d}" for i in range(n)], "label": rng.integers(0, 2, n)})
    frame["f"] = frame.label * 1.2 + rng.normal(size=n) + 300
    frame["g"] = rng.integers(0, 4, n).astype(float)
    frame["h"] = 2.5  # constant
    frame.loc[rng.random(n) < 0.3, "g"] = np.nan
    df = spark.createDataFrame(frame).repartition(3)
    df = df.withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    return frame, df.unionByName(df.limit(1).withColumns({"u": F.lit("P99"), "label": F.lit(None).cast("long")}))


def prepared(train, test, features):
    medians = train[features].median().fillna(0.0)
    X, Z = train[features].fillna(medians), test[features].fillna(medians)
    mean, sd = X.mean(), X.std(ddof=0)
    scale = lambda a: np.column_stack([np.ones(len(a)), np.where(sd > 1e-12, (a - mean) / sd.where(sd > 1e-12, 1.0), 0.0)])
    return scale(X), scale(Z)


def refit(train, test, features, loss="logistic", y=None):
    """Scores of ``test`` under a plain fit on ``train``."""
    y = train.label.to_numpy() if y is None else y
    X, Z = prepared(train, test, features)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, ridge = np.zeros(X.shape[1]), np.diag([0.0 if loss == "logistic" else 1.0] + [1.0] * len(features))
    for i in range(200):
        eta = X @ b
        if loss == "logistic":
            p = 1 / (1 + np.exp(-eta))
            pull, curve = w * (y - p), w * p * (1 - p)
        else:
            side = 2 * y - 1
            short = np.maximum(1 - side * eta, 0)
            pull, curve = 2 * w * side * short, 2 * w * (short > 0)
        b = b + np.linalg.solve((X.T * curve) @ X + ridge + 1e-10 * np.eye(len(b)), X.T @ pull - ridge @ b) * min(1, 20 / (i + 1))
    return 1 / (1 + np.exp(-Z @ b))


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
def test_folds_and_groups(units, loss):
    frame, df = units
    folds = splits.assign_grouped_folds(df, "u", "label", 4, 1)
    groups = {"all": FEATURES, "some": ["g"]}
    got, fitted = learning.cross_validate(df, folds, "u", FEATURES, "label", groups=groups, loss=loss)
    assert set(fitted.status) == {"converged"}
    got = got.toPandas().set_index(["feature_group", "u"]).y_score
    held = folds.toPandas().set_index("u")["__fold"]
    for name, features in groups.items():
        for k in range(4):
            out = frame.u.map(held) == k
            want = refit(frame[~out], frame[out], features, loss)
            assert np.allclose([got[name, u] for u in frame.u[out]], want, atol=1e-6)
    assert len(got) == 2 * len(frame)


def test_leave_one_out_with_gaps(units):
    frame, df = units
    got, fitted = learning.cross_validate(df, splits.assign_leave_one_out(df.where("label IS NOT NULL"), "u"), "u", FEATURES, "label")
    got = got.toPandas().set_index("u").y_score
    assert len(got) == len(frame) and len(fitted.fits) == len(frame)
    for i, u in enumerate(frame.u):
        assert np.isclose(got[u], refit(frame.drop(i), frame.iloc[[i]], FEATURES)[0], atol=1e-6)


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_influence_equals_refits_without_the_unit(units):
    frame, df = units
    folds = splits.assign_grouped_folds(df, "u", "label", 3, 1)
    held = folds.toPandas().set_index("u")["__fold"]
    got = learning.influence_refits(df, folds, "u", FEATURES, "label").toPandas().set_index("removed_id")

    def pooled(rows):
        scores = pd.Series(index=rows.u, dtype=float)
        for k in range(3):
            out = rows.u.map(held) == k
            scores[rows.u[out]] = refit(rows[~out], rows[out], FEATURES)
        return auc(rows.label.to_numpy(), scores[rows.u].to_numpy())

    everyone = pooled(frame)
    for i, u in enumerate(frame.u):
        want = pooled(frame.drop(i))
        assert np.isclose(got.loc[u, "roc_auc"], want) and np.isclose(got.loc[u, "delta_roc_auc"], want - everyone)
    assert set(got.status) == {"complete"} and dict(got.removed_label) == dict(zip(frame.u, frame.label))


def test_deals_equal_refits_on_dealt_labels(units):
    from lectern.operators.resampling import permuted_labels

    frame, df = units
    folds = splits.assign_grouped_folds(df, "u", "label", 3, 1)
    held = folds.toPandas().set_index("u")["__fold"]
    row = learning.permutation_refits(df, folds, "u", ["f", "g"], "label", permutations=25, seed=3).first()
    dealt = permuted_labels(df.where("label IS NOT NULL").select("u", "label"), "u", 25, 3, "label").toPandas()

    def pooled(y):
        scores = pd.Series(index=frame.u, dtype=float)
        for k in range(3):
            out = frame.u.map(held) == k
            scores[frame.u[out]] = refit(frame[~out], frame[out], ["f", "g"], y=y[~out.to_numpy()])
        return auc(y, scores.to_numpy())

    true = pooled(frame.label.to_numpy())
    hits = sum(pooled(d.set_index("u").label[frame.u].to_numpy()) >= true - 1e-12 for _, d in dealt.groupby("iteration"))
    assert np.isclose(row.observed_roc_auc, true) and (row.n_permutations, row.n_at_or_above, row.unfinished_fits) == (25, hits, 0)
    assert np.isclose(row.permutation_p_value, (hits + 1) / 26)


def test_one_class_and_missing_everywhere(spark):
    rows = [("a", 0, 1.0, None), ("b", 0, 2.0, None), ("c", 1, 3.0, None), ("d", 0, 0.5, None)]
    df = spark.createDataFrame(rows, "u string, label int, f double, g double")
    folds = spark.createDataFrame([("a", 0, 2), ("b", 0, 2), ("c", 1, 2), ("d", 1, 2)], "u string, __fold int, __k int")
    got, fitted = learning.cross_validate(df, folds, "u", ["f", "g"], "label")
    assert dict(zip(fitted.fits.fold.tolist(), fitted.status)) == {0: "converged", 1: "skipped"}
    assert sorted(r["u"] for r in got.collect()) == ["a", "b"]
    state = fold_fits.status_rows(fitted, ["all"]).first()
    assert (state["converged_fits"], state["skipped_folds"]) == (1, 1)
    twice = df.unionByName(df)
    with pytest.raises(ValueError, match="several rows"):
        learning.cross_validate(twice, splits.assign_leave_one_out(df, "u"), "u", ["f", "g"], "label")


def test_scalers_of_training_rows(units):
    frame, df = units
    folds = splits.assign_grouped_folds(df, "u", "label", 4, 1)
    rows = fold_fits.fold_rows(df, folds, "u", ["f", "g"], "label")
    held = folds.toPandas().set_index("u")["__fold"]
    for r in fold_fits.scaler_rows(rows, ["f", "g"], 4).collect():
        train = frame[frame.u.map(held) != r["fold_id"]][r["feature"]]
        filled = train.fillna(train.median())
        assert np.allclose([r["median"], r["mean"], r["sd"]], [train.median(), filled.mean(), filled.std(ddof=0)])


# --- leaving out one unit each from shared sums -------------------------------------


def without(frame, unit, penalty=1.0):
    """Coefficients of the balanced fit on the rows of all other units, the penalty on scaled predictors."""
    train = frame[frame.u != unit]
    X, y = np.column_stack([np.ones(len(train)), train.a, train.b]), train.y.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.diag([0.0, *(penalty * X[:, 1:].var(axis=0))])
    b = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve((X.T * (w * p * (1 - p))) @ X + ridge, X.T @ (w * (y - p)) - ridge @ b)
    return b


@pytest.mark.parametrize(("units_", "tolerance"), [(6, 1e-8), (40, 0.5)])
def test_left_out_logistic(spark, units_, tolerance):
    """Exact by further steps where units are few; within the bound after one step where it is small."""
    from lectern.operators.left_out import left_out_logistic

    rng = np.random.default_rng(units_)
    n = 60 * units_
    frame = pd.DataFrame({"u": [f"P{i % units_:02d}" for i in range(n)], "a": rng.normal(size=n) * 20 + 50, "b": rng.integers(0, 2, n).astype(float)})
    frame["y"] = (rng.random(n) < 1 / (1 + np.exp(-(0.05 * (frame.a - 50) - frame.b + (np.arange(n) % units_ == 0))))).astype(int)
    df = spark.createDataFrame(frame).repartition(3)
    odd = spark.createDataFrame([("P00", None, 1.0, 1), ("P01", 1.0, 1.0, None), (None, 1.0, 1.0, 1), ("P02", 1.0, 1.0, 5)], "u string, a double, b double, y int")
    got = left_out_logistic(df.unionByName(odd), "u", "y", ["a", "b"], tolerance=tolerance).toPandas().set_index("u")
    assert set(got.status) == {"converged"} and len(got) == units_
    X = np.column_stack([np.ones(n), frame.a, frame.b])
    for u in got.index:
        off = np.abs(X @ (np.array(got.coefficients[u]) - without(frame, u))).max()
        assert off < (1e-6 if tolerance < 1e-6 else 0.01)


def test_left_out_logistic_of_one_class(spark):
    from lectern.operators.left_out import left_out_logistic

    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("b", 3.0, 1), ("b", 2.5, 0)], "u string, x double, y int")
    got = {r["u"]: (r["status"], r["coefficients"]) for r in left_out_logistic(df, "u", "y", ["x"]).collect()}
    assert got["b"] == ("one_class", None) and got["a"][0] == "converged"


# --- leaving out one row each: the fit in the row ------------------------------------


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
def test_rows_left_out_are_fitted_in_their_row(spark, loss):
    """Equal to fits over all rows; nearly no unit needs one, so no pass multiplies rows with fits."""
    from lectern.operators import one_out

    rng = np.random.default_rng(3)
    n = 6000
    frame = pd.DataFrame({"u": [f"P{i:05d}" for i in range(n)], "label": rng.integers(0, 2, n)})
    frame["f"] = frame.label * 0.8 + rng.normal(size=n) + 300
    frame["g"] = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n) * 5 + frame.f)
    frame["h"] = 2.5
    df = spark.createDataFrame(frame).withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    assigned = splits.assign_leave_one_out(df, "u")
    groups = {"all": FEATURES, "some": ["g"]}
    rows = fold_fits.fold_rows(df, assigned, "u", FEATURES, "label")
    passes = []
    over_rows, fold_fits.fit = fold_fits.fit, lambda r, f, fits, *a, **k: passes.append(len(fits)) or over_rows(r, f, fits, *a, **k)
    try:
        got, fitted = learning.cross_validate(df, assigned, "u", FEATURES, "label", groups=groups, loss=loss)
    finally:
        fold_fits.fit = over_rows
    assert len(fitted.fits) == 2 * n and sum(passes) < n / 10, passes
    assert {tuple(r) for r in fitted.statuses.collect()} == {("all", n, 0, 0, 0), ("some", n, 0, 0, 0)}
    got = got.toPandas().set_index(["feature_group", "fold_id"]).y_score
    some = [0, 1, 2, *rng.integers(0, n, 20).tolist(), int(frame.f.argmax()), int(frame.g.argmin())]
    exact = over_rows(rows, FEATURES, fold_fits.Fits.grid([-1], sorted(set(some)), groups=2), list(groups.values()), loss=loss)
    want = fold_fits.scored(exact, "u", list(groups)).toPandas()
    assert len(got) == 2 * n and len(want) == 2 * len(set(some))
    assert max(abs(got[r.feature_group, r.fold_id] - r.y_score) for r in want.itertuples()) < 1e-8
    assert one_out.one_row_a_unit(rows) and not one_out.one_row_a_unit(rows.unionByName(rows))
