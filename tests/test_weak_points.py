"""Top-ups of hot values, model checks and neighbours far away."""

import numpy as np
from pyspark.sql import functions as F

from tabloom.operators import augment as K
from tabloom.operators import models as MD
from tabloom.operators.knn import knn_predict
from tabloom.session import checkpoint_dir


def test_top_up_of_a_hot_value(spark):
    full = spark.range(9000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("c"),
                                    (F.col("id") % 7).cast("string").alias("d"))
    sample = full.where("c in ('v1', 'v2')").limit(5)
    enhanced, added = K.cover_categories(sample, full, ["c"], "k", n=4)
    counts = {r["c"]: r["count"] for r in added.groupBy("c").count().collect()}
    in_sample = {r["c"] for r in sample.collect()}
    assert counts == {r["c"]: 4 for r in full.select("c").distinct().collect() if r["c"] not in in_sample}
    ranked = K.sample_per_group(K._pairs(full, ["c", "d"], "k"), ["column", "value"], 4, 42)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    assert enhanced.count() == sample.count() + added.count()


def test_model_check(spark):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    root = f"{checkpoint_dir(spark)}/checked-models"
    for name, features in (("whole", ["a"]), ("other", ["k"])):
        MD.save_model(MD.fit_model(df, "y", features, "dt"), f"{root}/{name}")
    MD.save_model(MD.LinearScorer("line", {"a": 1.0}), f"{root}/line")
    spark.createDataFrame([("not json",)], "value string").write.mode("overwrite").text(f"{root}/broken/metadata")
    got = {r["path"].rsplit("/", 1)[1]: r for r in MD.check_models(spark, [f"{root}/{n}" for n in ("whole", "other", "line", "broken")], ["a"]).collect()}
    assert {n: (r["status"], r["loaded"]) for n, r in got.items()} == {
        "whole": ("ok", True), "other": ("missing_features", True), "line": ("ok", True), "broken": ("unreadable", False)}
    assert all(r["bytes"] > 0 and r["files"] > 0 and r["modified"] for r in got.values())
    summary = MD.model_summary(MD.check_models(spark, [f"{root}/{n}" for n in ("whole", "other")], ["a"]))
    assert {(r["status"], r["models"], r["loaded"]) for r in summary.collect()} == {("ok", 1, 1), ("missing_features", 1, 1)}


def test_neighbours_of_far_outliers_in_one_feature(spark):
    rng = np.random.default_rng(1)
    train = [(i, float(x), float(i)) for i, x in enumerate(np.concatenate([rng.normal(size=300), [1e9, 1.1e9, -1e12]]))]
    test = [(i, float(x)) for i, x in enumerate([0.0, 5e8, 1e12, -1e13, 3.0])]
    got = knn_predict(spark.createDataFrame(train, "k long, x double, y double"), spark.createDataFrame(test, "t long, x double"), ["x"], "y", "k", k=3, per_cell=4)
    want = {t: np.mean([y for _, _, y in sorted((abs(x - v), k, y) for k, v, y in train)[:3]]) for t, x in test}
    assert {r["t"]: r["prediction"] for r in got.collect()} == want
