import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import linear_cv as L
from tabloom.operators import models as MD

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 400
    a, b = rng.normal(3, 2, n), rng.normal(-1, 5, n)
    c = 0.7 * a + rng.normal(0, 0.5, n)
    y = 4 * a - 2 * b + 0.1 * c + rng.normal(0, 3, n) + 50
    return [(i, float(a[i]), float(b[i]), float(c[i]), 7.0, float(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark, rows):
    return MD.prepare_folds(spark.createDataFrame(rows, "id long, a double, b double, c double, flat double, y double"), "id", 4).cache()


def test_fold_sums(data):
    got = L.fold_sums(data, "y", FEATURES, "_fold", 4)
    for f in range(4):
        x = np.array([[1.0, *r] for r in data.where(F.col("_fold") == f).select(*FEATURES, "y").collect()])
        assert got[f] == pytest.approx(x.T @ x, rel=1e-12)


def test_folds_in_batches(data, monkeypatch):
    whole = L.fold_sums(data, "y", FEATURES, "_fold", 4)
    monkeypatch.setattr(L, "_WIDTH", 13)
    assert L.fold_sums(data, "y", FEATURES, "_fold", 4) == pytest.approx(whole, rel=1e-12)


@pytest.mark.parametrize("spec", ["lr", "ridge", "en", "lasso"])
def test_equal_to_direct_fits(data, spec):
    sums = L.fold_sums(data, "y", FEATURES, "_fold", 4)
    mine = {f: (c, i) for _, f, c, i in L.fold_models(sums, [spec])}
    for f in range(4):
        direct = MD.fit_model(data.where(F.col("_fold") != f), "y", FEATURES, spec).model.stages[-1]
        assert mine[f][0] == pytest.approx(direct.coefficients.toArray(), abs=2e-4)
        assert mine[f][1] == pytest.approx(direct.intercept, abs=2e-3)


def test_scores_equal_one_by_one(data):
    got = {(r.model, r.fold): r for r in L.cross_validate_linear(data, "y", FEATURES, ["ols", "dummy"], 4).collect()}
    assert len(got) == 8
    for spec, features in (("ols", FEATURES[:3]), ("dummy", FEATURES)):
        for f in range(4):
            test = MD.fit_model(data.where(F.col("_fold") != f), "y", features, spec).predict(data.where(F.col("_fold") == f), "p")
            want = MD.regression_metrics(test, "y", "p").first()
            for m in ("n", "MAE", "RMSE", "R2", "RMSLE", "MAPE"):
                assert got[spec, f][m] == pytest.approx(want[m], rel=1e-8), (spec, f, m)


def test_dependent_and_missing(spark, rows):
    df = MD.prepare_folds(spark.createDataFrame([(*r, 2 * r[1]) for r in rows] + [(999, None, 1.0, 2.0, 7.0, 5.0, 1.0), (998, 1.0, 1.0, 2.0, 7.0, float("nan"), 1.0)],
                                                "id long, a double, b double, c double, flat double, y double, twice double"), "id", 3)
    assert L.fold_sums(df, "y", ["a", "b", "twice"], "_fold", 3)[:, 0, 0].sum() == len(rows)
    beta, _ = L.solve(L.fold_sums(df, "y", ["a", "b", "twice"], "_fold", 3).sum(axis=0))
    assert np.isfinite(beta).all() and beta[0] + 2 * beta[2] == pytest.approx(4, abs=0.2)
    assert L.solve(np.zeros((4, 4))) == (pytest.approx(np.zeros(2)), 0.0)


def test_all_models_compared(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, flat double, y double")
    folds, top = MD.compare_models(df, "y", FEATURES[:3], "id", ["lr", "lasso", "dummy", "dt", "knn"], k=3, n_select=2)
    assert {(r.model, r.fold) for r in folds.collect()} == {(m, f) for m in ("lr", "lasso", "dummy", "dt", "knn") for f in range(3)}
    assert top.count() == 2 and top.first()["model"] == "lr"
    bases, meta = MD.stack(df, "y", FEATURES[:3], "id", ["lr", "dt"], k=3)
    assert MD.stack_predict(df, bases, meta).count() == len(rows)
