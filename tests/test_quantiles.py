"""Exact quantiles: equal to Spark's percentile, on ties, groups and odd values."""

import math

from pyspark.sql import functions as F

from tabloom.operators.missing import MissingHandler, clean_numeric
from tabloom.operators.profile import box_stats, describe_numeric
from tabloom.operators.quantiles import exact_quantiles, quantile_table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _frame(spark):
    return spark.range(5000).select(
        (F.col("id") * 7919 % 1000 / 7.0).alias("a"), (F.col("id") % 13).cast("double").alias("b"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") * 1.5).alias("c"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("half_zero"),
        F.when(F.col("id") % 3 == 0, float("nan")).otherwise(-F.col("id") * 1.0).alias("nans"),
        F.when(F.col("id") % 9 > 0, F.col("id") % 4).alias("g"))


def test_quantiles_match_percentile(spark):
    df = _frame(spark)
    cols = ["a", "b", "c", "half_zero", "nans"]
    got = exact_quantiles(df, cols, PROBS)
    ref = df.agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*[F.lit(p) for p in PROBS])).alias(c) for c in cols]).first()
    for c in cols:
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[c], ref[c])), c


def test_quantiles_by_group(spark):
    df = _frame(spark)
    got = {r["g"]: (r["q0"], r["q1"]) for r in quantile_table(df, ["half_zero"], [0.25, 0.5], by=["g"]).collect()}
    ref = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("half_zero", F.array(F.lit(0.25), F.lit(0.5))).alias("p")).collect()}
    assert set(got) == set(ref) and None in got
    assert all(math.isclose(a, b, abs_tol=1e-9) for g in got for a, b in zip(got[g], ref[g]))
    box = {r["category"]: r["median"] for r in box_stats(df, "g", "half_zero").collect()}
    assert all(math.isclose(box[g], ref[g][1], abs_tol=1e-9) for g in ref)


def test_empty_and_unknown(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, float("nan"))], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [None]} and exact_quantiles(df, []) == {}
    assert exact_quantiles(df.where("false"), ["x"]) == {"x": [None]}


def test_medians_of_fits(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,), (float("inf"),)], "x double")
    assert MissingHandler().fit(df.where("x is null or x < 100")).numeric_fill["x"] == 3.0
    assert [r["x"] for r in clean_numeric(df, "median").collect()] == [1.0, 3.0, 3.0, 10.0, 3.0]
    assert describe_numeric(df.where("x < 100")).first()["q25"] == 2.0


def test_jobs_do_not_grow_with_columns(spark):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs = []
    for n in (2, 12):
        sc.setJobGroup(f"quantiles-{n}", "")
        exact_quantiles(spark.range(200).select(*[(F.col("id") * (i + 1.5)).alias(f"c{i}") for i in range(n)]), [f"c{i}" for i in range(n)])
        jobs.append(len(tracker.getJobIdsForGroup(f"quantiles-{n}")))
    sc.setJobGroup("other", "")
    assert jobs[0] == jobs[1]
