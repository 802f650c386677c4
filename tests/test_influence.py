"""Refits without each unit, ranked in chunks, against fits over the rows and their n x n scores."""

import numpy as np
import pytest

from lectern.operators import fold_fits, influence, learning, one_out


def readers(spark, n, gaps):
    draw = np.random.default_rng(n)
    x = draw.normal(size=(n, 2)).round(2)
    x[1::7] = x[::7][: len(x[1::7])]  # equal readers: ties
    y = (x[:, 0] + 2 * draw.normal(size=n) > 0.3).astype(int)
    rows = [(f"p{i}", int(y[i]), None if gaps and i % 11 == 3 else float(x[i, 0]), float(x[i, 1]), i % 3, 3) for i in range(n)]
    data = spark.createDataFrame(rows, "u string, label int, a double, b double, __fold int, __k int")
    return data.select("u", "label", "a", "b"), data.select("u", "__fold", "__k")


@pytest.mark.parametrize("n, gaps, chunk", [(700, True, 90), (700, False, 10_000), (40, True, 10)])
def test_ranks_in_chunks_equal_ranks_of_all_scores(spark, monkeypatch, n, gaps, chunk):
    data, folds = readers(spark, n, gaps)
    monkeypatch.setattr(influence, "CHUNK", chunk)
    monkeypatch.setattr(influence, "BLOCK", 128)
    got = learning.influence_refits(data, folds, "u", ["a", "b"], "label").toPandas().set_index("removed_id").sort_index()
    monkeypatch.setattr(one_out, "one_row_a_unit", lambda rows: False)
    want = learning.influence_refits(data, folds, "u", ["a", "b"], "label").toPandas().set_index("removed_id").sort_index()
    assert len(got) == n and (got.status == want.status).all() and (got.removed_label == want.removed_label).all()
    for c in ("roc_auc", "pr_auc", "delta_roc_auc"):
        assert np.abs(got[c] - want[c]).max() < 1e-9, c


def test_refits_without_each_unit_make_no_row_a_score_and_few_fits_over_rows(spark, monkeypatch):
    data, folds = readers(spark, 3000, True)
    fits = []
    made = fold_fits.fit
    monkeypatch.setattr(fold_fits, "fit", lambda rows, features, which, *a, **k: fits.append(len(which)) or made(rows, features, which, *a, **k))
    monkeypatch.setattr(fold_fits, "scored", lambda *a: pytest.fail("n x n rows"))
    assert learning.influence_refits(data, folds, "u", ["a", "b"], "label").count() == 3000
    assert sum(fits) < 3000


def test_a_fold_without_a_fit_scores_nobody(spark):
    rows = [(f"p{i}", int(i in (0, 3)), float(i), 1.0 * (i % 4), i % 3, 3) for i in range(30)]  # both positives in fold 0
    data = spark.createDataFrame(rows, "u string, label int, a double, b double, __fold int, __k int")
    got = learning.influence_refits(data.select("u", "label", "a", "b"), data.select("u", "__fold", "__k"), "u", ["a", "b"], "label").toPandas()
    assert len(got) == 30 and got.roc_auc.isna().all()  # folds 1 and 2 are scored and have no positive
