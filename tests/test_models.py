"""Closed-form fits and metrics against numpy on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import fold_fits, learning, linear, metrics, resampling, splits


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    n, units = 900, 12
    unit = rng.integers(0, units, n)
    x = rng.normal(size=(n, 2))
    effect = rng.normal(size=units)
    frame = pd.DataFrame({"u": [f"P{i:02d}" for i in unit], "x1": x[:, 0] * 3 + 1, "x2": x[:, 1]})
    frame["y"] = 2 + 0.5 * frame.x1 - 1.2 * frame.x2 + effect[unit] + rng.normal(size=n)
    frame["b"] = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * frame.x1 - 0.8 * frame.x2)))).astype(int)
    return frame, spark.createDataFrame(frame).cache()


def design(frame):
    return np.column_stack([np.ones(len(frame)), frame.x1, frame.x2])


def ridge(frame, alpha=1.0):
    X = design(frame)
    penalty = np.diag([0.0, *(alpha * X[:, 1:].var(axis=0))])
    return np.linalg.solve(X.T @ X + penalty, X.T @ frame.y.to_numpy())


def test_cross_fitted_residuals_equal_refits(panel):
    frame, df = panel
    got = linear.cross_fitted_residuals(df, "u", "y", ["x1", "x2"], "r").select("u", "x1", "r").toPandas()
    want = []
    for unit, rows in frame.groupby("u"):
        beta = ridge(frame[frame.u != unit])
        want.append(pd.DataFrame({"x1": rows.x1, "want": rows.y - design(rows) @ beta}))
    merged = got.merge(pd.concat(want), on="x1")
    assert len(merged) == len(frame) and np.allclose(merged.r, merged.want)


def test_in_sample_residuals(panel):
    frame, df = panel
    got = linear.fit_residuals(df, "y", ["x1", "x2"], "r").select("x1", "r").toPandas().sort_values("x1")
    want = frame.assign(r=frame.y - design(frame) @ ridge(frame)).sort_values("x1")
    assert np.allclose(got.r, want.r)


def test_robust_errors(panel):
    frame, df = panel
    X, y = design(frame), frame.y.to_numpy()
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    e = y - X @ beta
    u = e / (1 - np.einsum("ij,jk,ik->i", X, inv, X))
    hc3 = np.sqrt(np.diag(inv @ (X.T * u**2) @ X @ inv))
    got = linear.ols_hc3(df, "y", ["x1", "x2"]).toPandas()
    assert np.allclose(got.estimate, beta) and np.allclose(got.std_error, hc3)
    scores = pd.DataFrame(X * e[:, None]).groupby(frame.u.to_numpy()).sum().to_numpy()
    g, n, k = len(scores), len(y), 3
    se = np.sqrt(np.diag(inv @ scores.T @ scores @ inv) * g / (g - 1) * (n - 1) / (n - k))
    assert np.allclose(linear.ols_clustered(df, "y", ["x1", "x2"], "u").toPandas().std_error, se)


def newton(X, y, w, penalty, steps=50):
    b = np.zeros(X.shape[1])
    ridge_ = np.diag(penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve((X.T * (w * p * (1 - p))) @ X + ridge_, X.T @ (w * (y - p)) - ridge_ @ b)
    return b


def test_logistic_fit_per_key(panel):
    frame, df = panel
    got = learning.fit_linear_classifiers(df, ["u"], ["x1", "x2"], "b", penalty=1.0).toPandas().set_index("u")
    for unit, rows in frame.groupby("u"):
        want = newton(design(rows), rows.b.to_numpy(), np.ones(len(rows)), [0, 1, 1])
        assert np.allclose(got.loc[unit, "coefficients"], want, atol=1e-6)


def test_clustered_logistic_matches_newton(panel):
    frame, df = panel
    got = linear.logistic_clustered(df, "b", ["x1", "x2"], "u").toPandas()
    X, y = design(frame), frame.b.to_numpy()
    b = newton(X, y, np.ones(len(y)), [0, 0, 0])
    p = 1 / (1 + np.exp(-X @ b))
    inv = np.linalg.inv((X.T * (p * (1 - p))) @ X)
    scores = pd.DataFrame(X * (y - p)[:, None]).groupby(frame.u.to_numpy()).sum().to_numpy()
    g, n = len(scores), len(y)
    se = np.sqrt(np.diag(inv @ scores.T @ scores @ inv) * g / (g - 1) * (n - 1) / (n - 3))
    assert np.allclose(got.estimate, b, atol=1e-6) and np.allclose(got.std_error, se, atol=1e-6)


def test_squared_hinge_has_zero_gradient(panel):
    frame, df = panel
    fit = learning.fit_linear_classifiers(df.withColumn("k", F.lit(1)), ["k"], ["x1", "x2"], "b", loss="squared_hinge").first()
    b, X, side = np.array(fit.coefficients), design(frame), 2 * frame.b.to_numpy() - 1
    short = np.maximum(0, 1 - side * (X @ b))
    assert np.allclose(b - 2 * X.T @ (side * short), 0, atol=1e-4)


def test_random_intercept_is_a_maximum(panel):
    frame, df = panel
    row = linear.random_intercept(df, "y", ["x1", "x2"], "u").toPandas()

    def loglik(theta, variance, beta):
        total = 0.0
        for _, rows in frame.groupby("u"):
            n = len(rows)
            V = variance * (np.eye(n) + theta * np.ones((n, n)))
            e = rows.y.to_numpy() - design(rows) @ beta
            total += -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(V)[1] + e @ np.linalg.solve(V, e))
        return total

    beta, variance = row.estimate.to_numpy(), row.residual_variance[0]
    theta = row.unit_variance[0] / variance
    best = loglik(theta, variance, beta)
    assert np.isclose(best, row.log_likelihood[0])
    for factor in (0.9, 1.1):
        assert best >= loglik(theta * factor, variance, beta) and best >= loglik(theta, variance * factor, beta)


def test_mixed_effects_reports_what_it_skips(panel):
    _, df = panel
    out = linear.mixed_effects(df, {"ok": {"outcome": "y", "fixed_effects": ["x1", "x1:x2"]}, "no": {"outcome": "z", "fixed_effects": ["x1"]}}, "u").toPandas()
    assert set(out[out.hypothesis == "no"].status) == {"skipped"} and "x1_x_x2" in set(out.term.dropna())


def test_metrics_by_definition(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"y_true": rng.integers(0, 2, 200), "y_score": rng.random(200).round(1)})
    row = metrics.binary_metrics(spark.createDataFrame(frame), []).first()
    pos, neg = frame[frame.y_true == 1].y_score.to_numpy(), frame[frame.y_true == 0].y_score.to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, recall = 0.0, 0.0
    for s in sorted(frame.y_score.unique(), reverse=True):
        kept = frame[frame.y_score >= s]
        r = kept.y_true.sum() / len(pos)
        ap, recall = ap + (r - recall) * kept.y_true.mean(), r
    assert np.isclose(row.roc_auc, auc) and np.isclose(row.pr_auc, ap)
    assert np.isclose(row.brier_score, ((frame.y_true - frame.y_score) ** 2).mean())
    one = metrics.binary_metrics(spark.createDataFrame(frame[frame.y_true == 1]), []).first()
    assert one.roc_auc is None and one.macro_f1 is None and one.calibration_observed_rate == 1.0


def test_calibration_line(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0.05, 0.95, 400)
    frame = pd.DataFrame({"y_true": (rng.random(400) < p).astype(int), "y_score": p})
    row = metrics.calibration_line(spark.createDataFrame(frame), []).first()
    x = np.log(p / (1 - p))
    want = newton(np.column_stack([np.ones(400), x]), frame.y_true.to_numpy(), np.ones(400), [0, 0])
    assert np.allclose([row.calibration_intercept, row.calibration_slope], want, atol=1e-5)
    flat = metrics.calibration_line(spark.createDataFrame(frame.assign(y_score=0.5)), []).first()
    assert flat.calibration_slope is None


def test_leave_one_out_auc(spark):
    frame = pd.DataFrame({"u": list("abcdef"), "y_true": [1, 0, 1, 0, 1, 0], "y_score": [0.9, 0.4, 0.4, 0.7, 0.6, 0.1]})
    got = metrics.leave_one_out_auc(spark.createDataFrame(frame), "u").toPandas().set_index("u")
    for unit in frame.u:
        rest = frame[frame.u != unit]
        pos, neg = rest[rest.y_true == 1].y_score.to_numpy(), rest[rest.y_true == 0].y_score.to_numpy()
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert np.isclose(got.loc[unit, "leave_one_roc_auc"], want)


def test_permuted_labels_keep_class_sizes(spark):
    frame = pd.DataFrame({"u": [f"P{i:02d}" for i in range(20)], "y_true": [1] * 7 + [0] * 13, "y_score": np.linspace(0, 1, 20)})
    dealt = resampling.permuted_labels(spark.createDataFrame(frame), "u", 30, 1).groupBy("iteration").agg(F.sum("y_true").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(dealt) == 30 and {(r.p, r.n) for r in dealt} == {(7, 20)}


def test_cross_validation_gives_one_prediction_each(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"u": [f"P{i:02d}" for i in range(30)], "label": [i % 2 for i in range(30)]})
    frame["f"] = frame.label * 1.5 + rng.normal(size=30)
    frame["g"] = rng.normal(size=30)
    frame.loc[3, "g"] = np.nan
    df = spark.createDataFrame(frame).withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    folds = splits.assign_grouped_folds(df, "u", "label", 3, 1)
    groups = {"both": ["f", "g"], "one": ["g"]}
    scored, fitted = learning.cross_validate(df, folds, "u", ["f", "g"], "label", groups=groups)
    coefficients = fold_fits.coefficient_rows(fitted, groups)
    rows = scored.toPandas()
    assert rows.groupby("feature_group").u.nunique().eq(30).all() and len(rows) == 60
    held = folds.toPandas().set_index("u")["__fold"]
    for fold in (0, 1, 2):
        train = frame[frame.u.map(held) != fold]
        X = train[["f", "g"]].fillna(train[["f", "g"]].median())
        Z = ((X - X.mean()) / X.std(ddof=0)).to_numpy()
        w = train.label.map(len(train) / (2 * train.label.value_counts())).to_numpy()
        want = newton(np.column_stack([np.ones(len(Z)), Z]), train.label.to_numpy(), w, [0, 1, 1])
        got = coefficients.where((F.col("feature_group") == "both") & (F.col("fold_id") == fold)).toPandas().set_index("feature").coefficient
        assert np.allclose([got["f"], got["g"]], want[1:], atol=1e-5)


def test_association_model_recovers_slopes(panel):
    frame, df = panel
    out = linear.association_model(df, "y", ["x1", "x2"], "u").toPandas().set_index("term")
    assert np.isclose(out.loc["x1_z", "estimate"], 0.5 * frame.x1.std(), atol=0.15) and out.loc["x1_z", "n_bootstrap"] == 12
    assert out.loc["x1_z", "ci_low"] <= out.loc["x1_z", "ci_high"]


def test_status_of_fits(spark):
    apart = pd.DataFrame({"k": ["a"] * 8 + ["b"] * 8, "x": [-4.0, -3, -2, -1, 1, 2, 3, 4] * 2, "y": [0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 1, 0, 1, 0, 1, 1]})
    df = spark.createDataFrame(apart)
    free = learning.fit_linear_classifiers(df, ["k"], ["x"], "y", penalty=0.0)
    assert {r["k"]: r["status"] for r in free.collect()} == {"a": "separated", "b": "converged"}
    held = learning.fit_linear_classifiers(df, ["k"], ["x"], "y", penalty=1.0)
    assert {r["status"] for r in held.collect()} == {"converged"}


def test_calibration_of_certain_scores_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y_true int, y_score double")
    assert tuple(metrics.calibration_line(df, []).first()) == (None, None)
