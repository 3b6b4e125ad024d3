"""Trees on summed rows against the same trees on the rows."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabloom.operators import cells as C
from tabloom.operators import models as MD
from tabloom.operators.metrics import regression_metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = []
    for i in range(1500):
        a, b = float(rng.randint(1, 40)), rng.choice([0.0, 1.0, 2.0])
        made.append((i, a, b, a * 2 + b * 7 + rng.gauss(0, 3)))
    return spark.createDataFrame(made, "id long, a double, b double, y double").cache()


def _on_rows(df, spec, params=None):
    va = VectorAssembler(inputCols=["a", "b"], outputCol="_features", handleInvalid="keep")
    return MD.MLScorer(spec, Pipeline(stages=[va, MD.estimator(spec, "y", params)]).fit(df), ["a", "b"])


def _both(df, one, other):
    return other.predict(one.predict(df, "p"), "q").select("p", "q").collect()


@pytest.mark.parametrize("spec, params", [("dt", {"maxDepth": 4, "minInstancesPerNode": 50}), ("dt", {"minInstancesPerNode": 800}), ("gbr", {"maxIter": 4})])
def test_same_trees_as_on_rows(rows, spec, params):
    for r in _both(rows, _on_rows(rows, spec, params), MD.fit_model(rows, "y", ["a", "b"], spec, params)):
        assert r["p"] == pytest.approx(r["q"], abs=1e-9)


def test_fit_sees_cells(rows, monkeypatch):
    sizes = []
    fit = C.fit_tree
    monkeypatch.setattr(C, "fit_tree", lambda train, *a, **k: (sizes.append(train.count()), fit(train, *a, **k))[1])
    MD.fit_model(rows, "y", ["a", "b"], "dt")
    MD.tune(rows, "y", ["a", "b"], "id", "dt", {"maxDepth": [2, 3]}, k=3)
    assert len(sizes) == 7 and max(sizes) <= 40 * 3


def test_feature_of_many_values_is_cut(rows):
    df = rows.withColumn("a", F.col("a") + F.col("id") / 1000)
    binning = C.fit_binning(df, ["a", "b"])
    assert binning.inputs == ["_bin_0", "b"] and C.cell_table(df, "y", binning).count() <= 32 * 3
    scores = [regression_metrics(m.predict(df, "_p"), "y", "_p").first()["R2"] for m in (MD.fit_model(df, "y", ["a", "b"], "dt"), _on_rows(df, "dt"))]
    assert scores[0] == pytest.approx(scores[1], abs=0.01)


def test_folds_as_on_rows(rows):
    data = MD.prepare_folds(rows, "id", 3)
    got = {(r["model"], r["fold"]): r for r in C.cross_validate_cells(data, "y", ["a", "b"], {"t": ("dt", {"minInstancesPerNode": 20}), "g": ("gbr", {"maxIter": 2})}, 3).collect()}
    for model, spec, params in (("t", "dt", {"minInstancesPerNode": 20}), ("g", "gbr", {"maxIter": 2})):
        for f in range(3):
            held = _on_rows(data.where(F.col("_fold") != f), spec, params).predict(data.where(F.col("_fold") == f), "_p")
            want = regression_metrics(held, "y", "_p").first()
            assert got[model, f]["n"] == want["n"]
            for m in ("MAE", "RMSE", "R2", "MAPE"):
                assert got[model, f][m] == pytest.approx(want[m], abs=1e-9)


def test_missing_label_is_refused(spark, rows):
    with pytest.raises(Exception, match="(?i)label"):
        MD.fit_model(rows.withColumn("y", F.when(F.col("id") != 3, F.col("y"))), "y", ["a", "b"], "dt")


def test_missing_feature_is_refused(rows):
    for a in (F.col("a"), F.col("a") + F.col("id") / 1000):            # kept and cut
        with pytest.raises(Exception, match="NaN"):
            MD.fit_model(rows.withColumn("a", F.when(F.col("id") != 3, a)), "y", ["a", "b"], "dt")


def test_forest_is_fitted_on_bags_of_rows(rows):
    """Bags' sums are those of the rows as often as each was drawn; the forest learns from them."""
    data = MD.prepare_folds(rows, "id", 3)
    made = C.fold_cells(data, "y", ["a", "b"])
    bags = C.bag_table(data, "y", made.binning, "id", ["_fold"], 2, 123)
    drawn = data.withColumn("w", MD.poisson_weight(F.col("id"), 124)).groupBy("_fold", "a", "b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
    both = bags.join(drawn, ["_fold", "a", "b"]).collect()
    assert len(both) == made.cells.count()
    for r in both:
        assert r["_n1"] == r["n"] and r["_s1"] == pytest.approx(r["s"])
    assert made.much_fewer(4) and not made.much_fewer(1500)
    with ThreadPoolExecutor(4) as pool:
        forests = C.forest_fits(made, "id", 2, pool, trees=4)
    assert [len(f.trees) for f in forests] == [4, 4]
    fold = data.where(F.col("_fold") == 1)
    assert regression_metrics(forests[1].predict(fold, "p"), "y", "p").first()["R2"] > 0.9


def _bag_on_rows(df, n, seed=123):
    drawn = df.select("y", "a", "b", *[MD.poisson_weight(F.col("id"), seed + i).alias(f"_w{i}") for i in range(n)])
    return [MD.fit_model(drawn, "y", ["a", "b"], "dt", name=f"dt_bag{i}", weight=f"_w{i}") for i in range(n)]


def _one_by_one(df, models):
    for m in models:
        df = m.predict(df, f"_p_{m.name}")
    return df.withColumn("prediction", sum([F.col(f"_p_{m.name}") for m in models], F.lit(0.0)) / float(len(models)))


def test_bags_are_fitted_on_cells(rows, monkeypatch):
    sizes, fit = [], C.fit_tree
    monkeypatch.setattr(C, "fit_tree", lambda train, *a, **k: (sizes.append(train.count()), fit(train, *a, **k))[1])
    df = rows.unionByName(rows.limit(3).withColumn("id", F.lit(None).cast("long")))                # without a key: ten times in every bag
    models = MD.bag(df, "y", ["a", "b"], "id", "dt", n=3)
    assert len(sizes) == 3 and max(sizes) <= 40 * 3
    want = [r["prediction"] for r in _one_by_one(df, _bag_on_rows(df, 3)).orderBy("id", "y").collect()]
    got = MD.bag_predict(df, models)
    assert got.columns == [*df.columns, "prediction"]
    assert [r["prediction"] for r in got.orderBy("id", "y").collect()] == pytest.approx(want, abs=1e-9)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("struct(a") == 1                # one vector a row


def test_bag_refuses_a_missing_label_that_it_does_not_draw(rows):
    lost = rows.where(MD.poisson_weight(F.col("id"), 123) == 0).limit(1)
    df = rows.join(lost.select("id"), "id", "left_anti").unionByName(lost.withColumn("y", F.lit(None).cast("double")))
    for fits in (lambda: _bag_on_rows(df, 1), lambda: MD.bag(df, "y", ["a", "b"], "id", "dt", n=1)):
        with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
            fits()


def test_bag_of_cut_features_and_of_other_models(rows):
    df = rows.withColumn("a", F.when(F.col("id") > 5, F.col("a") + F.col("id") / 1000)).fillna(0.5, ["a"])
    for spec, n in (("dt", 2), ("lr", 2), ("ols", 1)):
        models = MD.bag(df, "y", ["a", "b"], "id", spec, n=n) if spec != "ols" else [MD.ols(df, "y", ["a", "b"])]
        gone = df.withColumn("a", F.when(F.col("id") % 9 > 0, F.col("a")))                         # a missing value is scored, too
        want, got = [[r["prediction"] for r in x.orderBy("id").collect()] for x in (_one_by_one(gone, models), MD.bag_predict(gone, models))]
        assert [repr(w) for w in want] == [repr(g) for g in got]


def test_binning_is_exact_near_its_limit(spark):
    df = spark.range(3000).select(*[(F.col("id") % n).cast("double").alias(f"v{n}") for n in (7, 95, 106, 400)])
    assert set(C.fit_binning(df, df.columns).cuts) == {"v106", "v400"}
