import math
import random

from pyspark.sql import functions as F

from tabloom.llm import topk as T

EMB = "vec_id long, embedding array<float>, label int, v int, dim string, rank int"


def brute(rows, every, k):
    sound = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows
             if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, a in sound:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -p) for r, (p, i) in enumerate(s[:k])}
    return out


def _run(spark, rows, every=5, k=10, **how):
    df = spark.createDataFrame([(*r, 1, 2, "d", 3) for r in rows], EMB)
    return {tuple(r) for r in T.top_k(T.integer_vectors(df), F.col("vec_id") % every == 0, k, **how).collect()}


def _float(x):
    import numpy as np
    return float(np.float32(x))


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [_float(rng.gauss(0, 1)) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [_float(x) for x in (0.5, -0.5, 0.25, 0, 0, 0, 0, 1)]) for i in range(150)]       # a hot vector: ties
    rows += [(2000 + i, [_float(rng.gauss(0, 30)) for _ in range(3)]) for i in range(30)]
    rows += [(5, None), (10, []), (15, [float("nan")] * 8), (20, [None, *[0.0] * 7]), (25, [float("inf"), *[0.0] * 7]), (None, [1.0] * 8), (3000, [1.0, 2.0])]
    rows = [r for r in rows if r[0] not in (5, 10, 15, 20, 25) or r[1] is None or len(r[1]) != 8 or r[1][0] != r[1][0] or None in r[1] or math.isinf(r[1][0])]
    want = brute(rows, 5, 10)
    assert _run(spark, rows) == want
    assert _run(spark, rows, block=37, query_block=11, sample=16, pivots=3) == want


def test_few_rows(spark):
    assert _run(spark, []) == set()
    assert _run(spark, [(0, [1.0, 0.0])]) == set()
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    assert _run(spark, rows) == {(0, 1, 1, 0), (0, 2, 2, -1048576)}
    big = [(i, [_float(2.0 ** 15), _float(i)]) for i in range(20)]            # products beyond 2^53 stay exact
    assert _run(spark, big) == brute(big, 5, 10)


def test_large_components(spark):
    rows = [(0, [2097151.0] * 4), (1, [2097151.0] * 4), (2, [1.0] * 4)]
    assert _run(spark, rows) == {(0, 1, 1, 2 ** 63 - 1), (0, 2, 2, 4 * 2097151 * 1024 * 1024)}
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(2 ** 21, 5, -3), (2 ** 20, -7, 1), (-(2 ** 21), 2, 2), (2 ** 19, 1, 1), (3, 2, 1)])]
    assert _run(spark, rows, every=1) == {(q, r, v, max(-2 ** 63, min(s, 2 ** 63 - 1))) for q, r, v, s in brute(rows, 1, 10)}
    huge = {r[:3] for r in _run(spark, [(0, [3e38]), (1, [-3e38]), (2, [1.0])])}
    assert huge == {(0, 1, 2), (0, 2, 1)}
