import math
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import whitening as W

EMB = "vec_id long, embedding array<float>, label int, x string, entries int, component long"


def scatter(rows):
    away = rows - rows.mean(axis=0)
    return away.T @ away


def sound(s, rows):
    want = scatter(rows.astype(float))
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(rows.shape[1])).max() < 1e-10
    assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-9 * size
    assert (np.diff(s.values) >= 0).all() and s.n == len(rows) and [int(v) for v in s.sums] == [int(v) for v in rows.sum(axis=0)]


@pytest.mark.parametrize("kind", ["plain", "equal", "few", "line", "axis", "scales"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(1)
    rows = {"plain": lambda: rng.normal(size=(200, 9)) * 64, "equal": lambda: np.ones((20, 9)), "few": lambda: rng.normal(size=(4, 9)) * 64,
            "line": lambda: np.outer(np.arange(50), np.arange(9)), "axis": lambda: np.eye(9)[rng.integers(0, 9, 300)] * 64,
            "scales": lambda: rng.normal(size=(300, 9)) * 10.0 ** np.arange(9)}[kind]()
    rows = np.floor(rows).astype(np.int64) + 1_000_000
    s = W.Spectrum(9)
    s.add(rows)
    sound(s, rows)
    parts = [W.Spectrum(9) for _ in range(4)]
    for k, p in enumerate(parts):
        p.add(rows[k::4] if k < 3 else rows[3::4])
    for p in parts[1:]:
        parts[0].merge(p)
    sound(parts[0], np.concatenate([rows[k::4] for k in range(4)]))


def test_secular_roots():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        poles, z = np.sort(rng.normal(size=n)) * 10.0 ** rng.integers(-3, 3), rng.normal(size=n) * 10.0 ** rng.integers(-4, 2, n)
        roots, away = W.secular_roots(poles, z)
        assert roots == pytest.approx(np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z)), rel=1e-10, abs=1e-12)
        assert away == pytest.approx(poles - roots[:, None], abs=1e-9)


def brute(rows, components=16):
    """Rows by numpy's eigh; whitened up to the sign of each component."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in kept}:
        fit = sorted({tuple(x) for _, x in kept if len(x) == dim})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([s / n for s in sums])
        away = np.array(fit, dtype=float) - mean
        values, axes = np.linalg.eigh(away.T @ away / n)
        values, axes = values[::-1], axes[:, ::-1]
        for i, x in kept:
            if len(x) == dim:
                far = sum((n * a - s) ** 2 for a, s in zip(x, sums))
                for k in range(min(components, dim)):
                    flat = values[k] <= 1e-12 * values[0] or values[0] <= 1e-9
                    w = None if flat else abs((np.array(x) - mean) @ axes[:, k]) / math.sqrt(values[k])
                    out.setdefault((i, k + 1, n, far), []).append((w, None if values[0] <= 1e-9 else values[k] / values.clip(0).sum()))
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component, r.n, r.deviation), []).append((None if r.whitened is None else abs(r.whitened), r.explained))
    assert Counter({k: len(v) for k, v in by.items()}) == Counter({k: len(v) for k, v in want.items()})
    for k, v in want.items():
        for (w, e), (w2, e2) in zip(sorted(v, key=str), sorted(by[k], key=str)):
            assert (w is None) == (w2 is None) and (e is None) == (e2 is None), k
            assert w is None or w == pytest.approx(w2, rel=1e-6, abs=1e-6)
            assert e is None or e == pytest.approx(e2, rel=1e-9, abs=1e-12)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], EMB)


def _rows(n=400, dim=20):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(n, dim)) * np.linspace(0.2, 3, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(mixed)]


def test_against_eigh(spark):
    hot = (7000, _rows()[3][1])
    rows = _rows() + [(7000 + i, hot[1]) for i in range(200)] + [hot, (None, hot[1])]                 # a third is one vector
    rows += [(1, None), (2, []), (3, [None] + [1.0] * 19), (4, [float("nan")] * 20), (5, [float("inf")] * 20)]
    got = W.whiten(_frame(spark, rows).repartition(7)).collect()
    compare(got, brute(rows))
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-6
    assert {r.n for r in got} == {400}


def test_merges_in_rounds(spark):
    rows = _rows(300, 5)
    one = W.fit_whitening(W.shifted_vectors(_frame(spark, rows)), 5)[5]
    many = W._tree(W.shifted_vectors(_frame(spark, rows)).select("x").repartition(23).mapInArrow(W._spectra, W._STATE), W._merged, W._STATE, 2)
    s = W._spectrum(many[0])
    assert len(many) == 1 and s.n == 300
    assert s.values[::-1] / 300 == pytest.approx(one["values"], rel=1e-9)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [0.5]), (4, [0.25]), (5, [9.0, 9.0, 9.0])]
    compare(W.whiten(_frame(spark, rows)).collect(), brute(rows))         # a flat dimension, one dimension, a single vector
    assert W.whiten(_frame(spark, [])).count() == 0
    assert W.whiten(_frame(spark, [(1, None), (2, [])])).count() == 0
    huge = W.whiten(_frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert all(r.deviation is None and r.n == 2 for r in huge)


def test_whole_table(spark):
    import duckdb

    from tabloom.llm.queries import QUERIES
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    compare(QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect(), brute([(i, None if v is None else list(v)) for i, v in rows]))
