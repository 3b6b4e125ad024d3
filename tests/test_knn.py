"""M25 exact k-NN against brute force on small fixtures (duplicates, ties, skew)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.knn import axis_borders, knn_predict


def brute(train, test, k):
    out = {}
    for tid, tx in test:
        d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(tx, x)))), key, y) for key, x, y in train)
        out[tid] = float(np.mean([y for _, _, y in d[:k]]))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_knn_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    train = []
    for i in range(400):
        if i < 130:                       # a third of the rows on one coordinate (hot group)
            x = (5.0, 5.0)
        else:
            x = (float(rng.integers(0, 40)) / 4, float(rng.integers(0, 20)) / 2)
        train.append((i, x, float(rng.normal(10, 3))))
    test = [(1000 + i, (float(rng.integers(-4, 44)) / 4, float(rng.integers(-2, 22)) / 2)) for i in range(60)]
    tr = spark.createDataFrame([(k, a, b, y) for k, (a, b), y in train], "key long, a double, b double, y double")
    te = spark.createDataFrame([(k, a, b) for k, (a, b) in test], "tid long, a double, b double")
    got = {r["tid"]: r["prediction"] for r in knn_predict(tr, te, ["a", "b"], "y", "key", k=5, per_cell=8).collect()}
    exp = brute(train, test, 5)
    assert set(got) == set(exp)
    for t in exp:
        assert abs(got[t] - exp[t]) < 1e-9, (t, got[t], exp[t])


def test_knn_fewer_rows_than_k(spark):
    tr = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 3.0)], "key long, a double, y double")
    te = spark.createDataFrame([(9, 0.2)], "tid long, a double")
    r = knn_predict(tr, te, ["a"], "y", "key", k=5).first()
    assert r["prediction"] == 2.0


def test_borders_are_numbered_without_gaps(spark):
    rows = [(float(i % 7), float(i)) for i in range(200)] + [(100.0, float(1000 + i)) for i in range(100)]
    got = axis_borders(spark.createDataFrame(rows, "_x0 double, _x1 double"), ["_x0", "_x1"], 10).orderBy("axis", "cell").collect()
    for axis in (0, 1):
        cells = [(r["cell"], r["from"]) for r in got if r["axis"] == axis]
        assert [c for c, _ in cells] == list(range(len(cells))) and [f for _, f in cells] == sorted({f for _, f in cells})
        assert cells[0][1] == min(row[axis] for row in rows) and len(cells) <= 10
    assert sum(r["axis"] == 1 for r in got) == 10            # no ties: ten even runs


def test_knn_ties_across_cell_borders_go_to_the_smaller_key(spark):
    # every test point has neighbours at equal distances on both sides, in other cells, with all key orders
    train = [((37 * i) % 64, float(i), float(i)) for i in range(64)]
    test = [(100 + i, i + 0.5) for i in range(63)] + [(200 + i, float(i)) for i in range(64)]
    got = knn_predict(spark.createDataFrame(train, "key long, a double, y double"), spark.createDataFrame(test, "tid long, a double"),
                      ["a"], "y", "key", k=3, per_cell=1).collect()
    want = {t: float(np.mean([y for _, _, y in sorted((abs(x - v), kk, y) for kk, v, y in train)[:3]])) for t, x in test}
    assert {r["tid"]: r["prediction"] for r in got} == want


def test_knn_missing_and_infinite_values(spark):
    nan, inf = float("nan"), float("inf")
    train = [(1, 0.0, 0.0, 1.0), (2, 1.0, 1.0, 3.0), (3, None, 0.0, 99.0), (4, 0.0, nan, 99.0), (5, inf, 0.0, 99.0), (6, 0.0, 0.0, None)]
    test = [(1, 0.1, 0.1, "x"), (2, None, 0.0, "x"), (3, nan, 0.0, "x"), (4, -inf, 0.0, "x"), (1, 0.1, 0.1, "x")]
    tr = spark.createDataFrame(train, "key long, a double, b double, y double")
    te = spark.createDataFrame(test, "tid long, a double, b double, prediction_key string")
    got = knn_predict(tr, te, ["a", "b"], "y", "key", k=1)
    assert got.columns == [*te.columns, "prediction"]
    assert sorted((r["tid"], r["prediction"]) for r in got.where("prediction is not null").collect()) == [(1, 1.0), (1, 1.0)]
    assert got.count() == 5
    assert knn_predict(tr, te.where("false"), ["a", "b"], "y", "key", k=1).count() == 0
    with pytest.raises(ValueError, match="empty training set"):
        knn_predict(tr.where("key = 3"), te, ["a", "b"], "y", "key")


def test_folds_together(spark, monkeypatch):
    """Every row gets the mean of its k nearest rows of other folds, from a search that sees k rows of a coordinate and fold at most."""
    from tabloom.operators import knn
    rng = random.Random(8)
    rows = [(i, i % 2 if i % 50 else None, float(rng.randint(0, 3)) if i % 3 else 1.0, float(rng.randint(0, 2)), None if i % 41 == 0 else float(rng.randint(0, 9)))
            for i in range(200)]
    rows += [(1000, 0, None, 1.0, 5.0), (1001, 1, float("nan"), 1.0, 5.0), (1002, 1, 1.0, float("inf"), 5.0), (1003, 1, 9.5, 9.5, 5.0)]
    df = spark.createDataFrame(rows, "id long, f int, x double, y double, label double")
    known = [r for r in rows if r[2] is not None and np.isfinite(r[2]) and np.isfinite(r[3])]
    want = [(r[1], r[4], None) for r in rows if r[1] is not None and r not in known]
    for f in (0, 1):
        here = [r for r in known if r[1] == f]
        near = brute([(r[0], r[2:4], r[4]) for r in known if r[1] == 1 - f and r[4] is not None], [(r[0], r[2:4]) for r in here], 5)
        want += [(f, r[4], round(near[r[0]], 9)) for r in here]
    most, plain = [], knn.knn_predict
    monkeypatch.setattr(knn, "knn_predict", lambda train, *rest: most.append(
        train.groupBy("_f0", "_f1", "fold").count().agg(F.max("count")).first()[0]) or plain(train, *rest))
    got = [(r["fold"], r["label"], None if r["_pred"] is None else round(r["_pred"], 9)) for r in knn.knn_folds(df, ["x", "y"], "label", "id", "f", 2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert most == [5, 5]
