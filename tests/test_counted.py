"""Counted values, label codes, as-of joins and copula marginals against plain Python."""

import bisect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators.asof import last_at_or_before
from tabloom.operators.counted import counted_values
from tabloom.operators.encode import LabelEncoder
from tabloom.operators.synth import fit_copula

SCHEMA = "k long, big long, x double, t string, b boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, (1 << 60) + rng.randrange(9) if i % 5 else None, rng.choice([None, float("nan"), -0.0, 0.0, 1.5, rng.random()]),
             rng.choice([None, "", "a;b", "hot", "hot", "hot", f"v{rng.randrange(60)}"]), rng.choice([True, False, None])) for i in range(900)]


def known(rows, i):
    return [r[i] for r in rows if r[i] is not None and r[i] == r[i]]


def test_counts(spark, rows):
    c = counted_values(spark.createDataFrame(rows, SCHEMA).repartition(7))
    for i, name in enumerate(["k", "big", "x", "t", "b"]):
        values = known(rows, i)
        assert (c.missing[name], c.distinct[name]) == (len(rows) - len(values), len(set(values))), name
    assert c.rows == len(rows) and c.with_semicolons() == {"t"}
    top = [(r["value"], r["n"]) for r in c.top_values(3, ["t"]).orderBy("rank").collect()]
    assert top == sorted(Counter(known(rows, 3)).items(), key=lambda p: (-p[1], p[0]))[:3]
    numbered = {r["value"]: (r["code"], r["before"]) for r in c.numbered().where("column = 't'").collect()}
    values = sorted(known(rows, 3))
    assert numbered == {v: (sorted(set(values)).index(v), bisect.bisect_left(values, v)) for v in set(values)}


def test_empty(spark):
    c = counted_values(spark.createDataFrame([], SCHEMA))
    assert c.rows == 0 and c.missing == dict.fromkeys(c.names, 0) and c.quantiles(["x"], [0.5]) == {"x": [None]}
    assert c.describe(["x"])["x"]["count"] == 0 and c.numbered().count() == 0


def test_label_codes_of_many_levels(spark):
    df = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("v"), (F.col("id") % 9000).cast("string"))).alias("c"))
    fitted = LabelEncoder().fit(df, ["c"])
    coded = fitted.codes(df)
    want = sorted({r["c"] if r["c"] is not None else fitted.token for r in df.collect()})
    got = {r["k"]: r["c"] for r in coded.collect()}
    assert got == {r["k"]: want.index(fitted.token) if r["c"] is None else bisect.bisect_left(want, r["c"]) for r in df.collect()}
    assert sorted(fitted.decode(coded).collect()) == sorted(df.collect())
    assert fitted.codes(spark.createDataFrame([(1, "never seen")], "k long, c string")).first()["c"] == -1


def test_last_at_or_before(spark):
    rng = random.Random(4)
    right = [(rng.choice(["a", "hot", None]), rng.random(), i) for i in range(200)]
    left = [(rng.choice(["hot", "hot", "a", "none", None]), rng.random(), i) for i in range(1500)]
    got = last_at_or_before(spark.createDataFrame(left, "g string, x double, i long"), spark.createDataFrame(right, "g string, x double, j long"), ["g"], "x")
    assert got.columns == ["g", "x", "i", "j"]
    by = {g: sorted((x, j) for h, x, j in right if h == g) for g in ("a", "hot", "none", None)}
    for g, x, i, j in got.collect():
        at = bisect.bisect_right(by[g], (x, 1 << 60)) - 1
        assert j == (by[g][at][1] if at >= 0 else None)
    assert got.count() == 1500


def test_copula_of_many_levels(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("c"),
                                  (F.col("id") % 50).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    cop = fit_copula(df, "k")
    assert cop.columns == ["c", "x"]
    drawn = cop.sample(spark, 6000, seed=2).collect()
    assert len(drawn) == 6000 and not [r for r in drawn if r["c"] is None or r["x"] is None]
    assert abs(sum(r["c"] == "hot" for r in drawn) - 2000) < 200
    assert cop.scores(spark.createDataFrame([(1, "never", 3.0), (2, None, None)], "k long, c string, x double"), "k").toPandas()["c"].isna().all()
