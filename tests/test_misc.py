"""Operators without a registered query of their own (schema reports, profile
bundle, narrowing, feature set counts)."""

from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, ShortType

from tabloom.operators import schema as S
from tabloom.operators.profile import profile
from tabloom.sources.io import feature_lists


def test_column_transformations_report(spark):
    df = spark.createDataFrame([(1, 2)], "`Project ID` int, `a-b (x)` int")
    new = S.fix_columns(S.clean_columns(df))
    rep = S.column_transformations(spark, df.columns, new.columns).orderBy("position").collect()
    assert [(r["old"], r["new"], r["changed"]) for r in rep] == [("Project ID", "project_id", 1), ("a-b (x)", "a_b_x", 1)]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, -5, 2.5)], "a long, b long, c double")
    out = S.narrow_types(df)
    assert isinstance(out.schema["a"].dataType, ShortType)     # uint8 -> short (no unsigned in Spark)
    assert isinstance(out.schema["b"].dataType, ByteType)
    assert isinstance(out.schema["c"].dataType, FloatType)


def test_columns_by_kind_and_counts(spark):
    df = spark.createDataFrame([(1, "x", True)], "n int, t string, b boolean")
    assert S.columns_by_kind(df) == {"numeric": ["n"], "categorical": ["t"], "boolean": ["b"], "other": []}
    cmp = S.compare_features(spark.createDataFrame([("a",), ("b",)], "feature string"),
                             spark.createDataFrame([("b",), ("c",)], "feature string"))
    counts = {r["status"]: r["n"] for r in S.feature_set_counts(cmp).collect()}
    assert counts == {"extra": 1, "valid": 1, "missing": 1}


def test_profile_bundle(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (3, 4.0, None)], "k long, v double, t string")
    out = profile(df, target="v")
    assert set(out) == {"missing", "summary", "describe", "distinct", "kinds", "top", "correlations", "target"}
    assert {r["column"]: r["kind"] for r in out["kinds"].collect()} == {"k": "categorical", "v": "categorical", "t": "categorical"}
    miss = {r["column"]: r["n_missing"] for r in out["missing"].collect()}
    assert miss == {"k": 0, "v": 1, "t": 1}


def test_feature_lists_master_order(spark):
    fl = feature_lists(spark, {"m1": ["a", "b"], "m2": ["b", "c"]})
    master = [r["feature"] for r in fl.where(F.col("model") == "__all__").orderBy("feature_index").collect()]
    assert master == ["a", "b", "c"]
