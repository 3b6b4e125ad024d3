"""One hand-made frame per chosen semantic and the
properties of SURVEY §5 (c)/(d)."""

import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import domain as J
from tabloom.functions import text as X
from tabloom.operators import encode as H
from tabloom.operators import metrics as M
from tabloom.operators import models as MD
from tabloom.operators import multivalue as G
from tabloom.operators import schema as S
from tabloom.plans.preprocess import FittedPreprocessor, Preprocessor


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


# --- C07 table test: the eight transformation examples ----------------------
EIGHT = [
    ("workflow support & management", "workflow support_management"),
    ("data entry &/or validation", "data entry _ validation"),
    ("file &/or print server", "file _ print server"),
    ("html/web server: security", "html_web server_security"),
    ("client (desktop) application", "client_desktop application"),
    ("database + file server", "database_file server"),
    ("agile development ; scrum", "agile development;scrum"),
    ("web development: html & css", "web development_html_css"),
]


def test_c07_eight_examples(spark):
    df = spark.createDataFrame([(a,) for a, _ in EIGHT], "v string")
    got = [r[0] for r in df.select(X.standardize_token(F.lower("v"))).collect()]
    assert got == [b for _, b in EIGHT]


def test_c07_synonyms_web_abbrev(spark):
    df = spark.createDataFrame([("stand alone",), ("web?",), ("psp team",), ("jad",), ("client server",)], "v string")
    got = [r[0] for r in df.select(X.standardize_token("v")).collect()]
    assert got == ["stand-alone", "web", "personal_software_process team", "joint_application_development",
                   "client-server"]


def test_tidy_cases(spark):
    df = spark.createDataFrame([(" Dog;Cat ; Fish ",), ("b; a; b; ;nan",), ("",), (None,), (";",)], "v string")
    plain = [r[0] for r in df.select(X.tidy_multivalue("v")).collect()]
    assert plain == ["cat; dog; fish", "a; b; nan", "", None, ""]
    strict = [r[0] for r in df.select(X.tidy_multivalue("v", strict=True)).collect()]
    assert strict == ["cat; dog; fish", "a; b", None, None, None]


def test_tidy_idempotent(spark):
    df = spark.createDataFrame([(" Dog;Cat ; Fish ",), ("b; a; b",), ("x",)], "v string")
    once = df.select(X.tidy_multivalue("v").alias("v"))
    twice = once.select(X.tidy_multivalue("v").alias("v"))
    assert rows(once) == rows(twice)


def test_t1_t2_null_token_and_fill(spark):
    df = spark.createDataFrame([(1, None), (2, " A ")], "id long, c string")
    assert rows(X.normalize_text(df), "c") == [(None,), ("a",)]
    assert rows(X.normalize_text(df, null_token="nan"), "c") == [("nan",), ("a",)]
    p = Preprocessor(None, threshold=0.9, keep=[], fill_value="Missing").fit(df)
    out = p.transform(df)
    assert "c_missing" in out.columns and "c_a" in out.columns   # cleaner lower-cases after the fill


def test_t3_t4_fit_once_one_schema(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0)], "id long, c string, v double")
    b = spark.createDataFrame([(4, "q", None)], "id long, c string, v double")
    fitted = Preprocessor(None, keep=[]).fit(a)
    assert fitted.transform(a).columns == fitted.transform(b).columns == fitted.output_columns()
    got = fitted.transform(b).first().asDict()
    assert got["c_x"] == 0 and got["c_y"] == 0 and got["c_z"] == 0 and got["v"] == 2.0
    again = FittedPreprocessor.from_json(fitted.to_json())
    assert again.transform(b).columns == fitted.transform(b).columns


def test_t5_dash_replaced_before_mapping(spark):
    df = spark.createDataFrame([(1, "Stand-Alone"), (2, "client server")], "id long, c string")
    fitted = Preprocessor(None, keep=[], mapping={"stand-alone": "SA", "client server": "CS"}).fit(df)
    out = fitted.transform(df)
    assert sorted(c for c in out.columns if c.startswith("c_")) == ["c_CS", "c_stand_alone"]


def test_t7_cardinality_inclusive(spark):
    df = spark.createDataFrame([(str(i),) for i in range(10)], "c string")
    assert "c_0" in H.OneHot(max_cardinality=10).fit(df).transform(df).columns
    assert "c" in H.OneHot(max_cardinality=9).fit(df).transform(df).columns


def test_t8_drop_first(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    cols = H.OneHot(drop_first=True).fit(df).transform(df).columns
    assert cols == ["c_b", "c_c"]


def test_t9_rule_order(spark):
    df = spark.createDataFrame([("EXTRA LARGE",), ("EXTRA SMALL",), ("XS",), ("Medium",)], "s string")
    got = rows(df.select(J.keyword_code("s", J.SIZE_FACTOR, 1.0), J.keyword_code("s", J.SIZE_CODE, "Missing")))
    assert got == [(1.5, "l"), (0.5, "s"), (0.5, "xs"), (1.0, "m1")]


def test_worked_effort_value(spark):
    df = spark.createDataFrame([(8, "Medium", "Web Application", "New Development")], "t int, s string, a string, d string")
    v = df.select(J.estimate_effort("t", "s", "a", "d")).first()[0]
    assert abs(v - 1.92) < 1e-12


def test_t10_t11_exact_suffix_and_pairs(spark):
    df = spark.createDataFrame([("a multi; b",), ("b",)], "c string")
    out, mapping = G.expand_multivalue(df, ["c"], "count_features", preserve=["c"])
    kinds = {n: k for n, k, _ in G.checks_for(mapping, "c")}
    assert kinds == {"c_count": "count", "c_unique_count": "unique_count", "c_has_most_common": "binary"}
    odd = spark.createDataFrame([("x_count; b",), ("b",)], "c string")          # a value that looks like another kind's name
    out, mapping = G.expand_multivalue(odd, ["c"], "top_k", preserve=["c"])
    assert G.checks_for(mapping, "c") == [("c_top_b", "binary", ["b"]), ("c_top_x_count", "binary", ["x_count"]), ("c_other", "other", ["b", "x_count"])]
    assert G.validation_summary(odd, out, mapping).first()["n_non_binary"] == 0
    cols, names = G.multivalue_topk(df, "c", values=["a multi", "b"])
    out = df.select("c", *cols)
    res = {r["new_column"]: r["match_rate"] for r in G.validate_flags(out, "c", [
        (names[0], "binary", "a multi"), (names[1], "binary", "b"), ("c_other", "other", ["a multi", "b"])]).collect()}
    assert all(v == 100.0 for v in res.values())


def test_t12_fold_summary(spark):
    scores = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 3.0)], "model string, fold int, MAE double")
    out = {r["fold"]: r["MAE"] for r in M.fold_summary(scores, metrics=["MAE"]).collect()}
    assert out["Mean"] == 2.0 and out["Std"] == 1.0


def test_t17_pop_vs_sample(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0)], "k long, a double, b double")
    r = df.select(*M.ensemble(["a", "b"])).first()
    assert r["ensemble_std"] == 1.0          # population
    d = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    from tabloom.operators.profile import describe_numeric
    assert abs(describe_numeric(d).first()["std"] - math.sqrt(2)) < 1e-12   # sample


def test_t18_ties_value_ascending(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    from tabloom.operators.missing import column_modes
    assert column_modes(df, ["c"]) == {"c": "a"}
    assert G.top_values(spark.createDataFrame([("b;a",)], "c string"), "c", 1) == ["a"]


def test_t19_floor(spark):
    df = spark.createDataFrame([(1, -5.0)], "k long, x double")
    m = MD.LinearScorer("m", {"x": 1.0})
    assert MD.score_all(df, [m], floor=0.1).first()["pred_m"] == 0.1
    assert MD.score_all(df, [m], floor=None).first()["pred_m"] == -5.0


def test_t20_strip_all_whitespace(spark):
    df = spark.createDataFrame([("\t a \n",)], "v string")
    assert df.select(X.strip_ws("v")).first()[0] == "a"


def test_t21_try_cast(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert rows(S.force_numeric(df), "v") == [(1.5,), (0.0,), (0.0,)]


def test_t22_rmsle_abs_mape_skips_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, -2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["MAPE"] == 2.0 and not math.isnan(r["RMSLE"])


# --- properties ---------------------------------------------------------------
def test_multihot_sums_to_distinct(spark):
    df = spark.createDataFrame([(1, "a;b;a"), (2, "c"), (3, None)], "k long, c string")
    fitted = G.MultiValueEncoder(10).fit(df, ["c"])
    out = fitted.transform(df)
    flags = [c for c in out.columns if c.startswith("c__")]
    got = out.select("k", sum([F.col(f) for f in flags], F.lit(0)).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [2, 1, 0]


def test_decode_encode_roundtrip(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, c string")
    enc = H.OneHot().fit(df).transform(df)
    dec = H.decode_flags(enc, {"c": {"x": "c_x", "y": "c_y"}}, default=None)
    assert rows(dec.orderBy("k"), "c") == [("x",), ("y",), (None,)]


def test_label_inverse_argmax(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k long, c string")
    f = H.LabelEncoder().fit(df, ["c"])
    oh = f.one_hot(df)
    lv = f.categories["c"]
    back = oh.select("k", H.argmax_level([f"c_{v}" for v in lv], lv).alias("c")).orderBy("k")
    assert rows(back, "c") == [("x",), (None,)]


def test_range_scaler_roundtrip(spark):
    df = spark.createDataFrame([(1.0, 10), (3.0, 20), (2.0, 15)], "a double, b long")
    f = H.RangeScaler().fit(df, {"a": "continuous", "b": "discrete"})
    back = f.inverse(f.transform(df))
    assert rows(back) == [(1.0, 10), (3.0, 20), (2.0, 15)]


def test_attributions_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "k long, a double, b double")
    m = MD.LinearScorer("m", {"a": 2.0, "b": -1.0}, 3.0)
    attr = MD.linear_attribution(df, m, "k")
    tot = attr.groupBy("k").agg(F.sum("value").alias("s"))
    pred = m.predict(df, "p")
    mean_p = pred.agg(F.avg("p")).first()[0]
    j = tot.join(pred, "k").select((F.col("s") - (F.col("p") - mean_p)).alias("d"))
    assert all(abs(r["d"]) < 1e-9 for r in j.collect())


def test_ols_recovers_planted_line(spark):
    df = spark.range(200).select((F.col("id") / 10).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", 2 * F.col("a") + 3 * F.col("b") - 1)
    m = MD.ols(df, "y", ["a", "b"])
    assert abs(m.coefs["a"] - 2) < 1e-9 and abs(m.coefs["b"] - 3) < 1e-9 and abs(m.intercept + 1) < 1e-9


def test_vif_matches_uncentered_r2(spark):
    from tabloom.operators.correlation import vif
    df = spark.range(50).select((F.col("id") + 1).cast("double").alias("x"), ((F.col("id") * 7) % 11 + 1).cast("double").alias("z"))
    v = {r["column"]: r["vif"] for r in vif(df, ["x", "z"]).collect()}
    xs = [float(i + 1) for i in range(50)]
    zs = [float((i * 7) % 11 + 1) for i in range(50)]
    sxx, szz, sxz = sum(a * a for a in xs), sum(b * b for b in zs), sum(a * b for a, b in zip(xs, zs))
    expect = 1 / (1 - sxz * sxz / (sxx * szz))
    assert abs(v["x"] - expect) < 1e-9 and abs(v["z"] - expect) < 1e-9


def test_vif_of_dependent_and_badly_scaled_columns(spark):
    from tabloom.operators.correlation import vif
    df = spark.range(60).select(F.col("id").cast("double").alias("x"), (2 * F.col("id")).cast("double").alias("y"),
                                (((F.col("id") * 7) % 11 + 1) * 1e5).alias("big"), (((F.col("id") * 5) % 13 + 1) * 1e-2).alias("small"))
    v = {r["column"]: r for r in vif(df, ["x", "y", "big", "small"]).collect()}
    assert v["x"]["vif"] == v["y"]["vif"] == math.inf and v["x"]["high"] == 1
    alone = {r["column"]: r["vif"] for r in vif(df, ["x", "big", "small"]).collect()}
    assert abs(v["big"]["vif"] - alone["big"]) < 1e-6 and abs(v["small"]["vif"] - alone["small"]) < 1e-6


def test_wide_correlations(spark):
    import numpy as np
    import pandas as pd
    from tabloom.operators.correlation import correlations
    p = 60
    x = np.random.default_rng(1).normal(size=(300, p)) * np.logspace(-3, 6, p) + 1e4
    x[::7, 3], x[:, 5] = np.nan, 7.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])
    got = {(r["a"], r["b"]): r["r"] for r in correlations(spark.createDataFrame(pdf), list(pdf.columns), pairs_once=True).collect()}
    want = pdf.corr()
    assert len(got) == p * (p - 1) // 2
    for (a, b), r in got.items():
        assert (math.isnan(r) and math.isnan(want.loc[a, b])) or abs(r - want.loc[a, b]) < 1e-6, (a, b)


def test_many_raw_spellings_of_few_levels_are_encoded(spark):
    from tabloom.plans.preprocess import Preprocessor
    rows = [(i, f"raw {i % 60}") for i in range(600)]
    mapping = {f"raw {k}": f"level {k % 5}" for k in range(60)}
    df = spark.createDataFrame(rows, "id long, kind string")
    fitted = Preprocessor(mapping=mapping).fit(df)
    assert sorted(fitted.single_levels["kind"]) == [f"level {k}" for k in range(5)]
    assert sum(c.startswith("kind_") for c in fitted.transform(df).columns) == 5


def test_nan_is_missing(spark):
    from tabloom.operators.missing import MissingHandler, SimpleImputer
    from tabloom.operators.profile import describe_numeric
    from tabloom.plans.preprocess import Preprocessor
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,), (nan,), (nan,)], "x double")
    for fitted in (MissingHandler(threshold=0.9).fit(df), SimpleImputer().fit(df), Preprocessor(threshold=0.9).fit(df)):
        assert [r["x"] for r in fitted.transform(df).collect()] == [1.0, 2.0, 1.5, 1.5, 1.5]
    d = describe_numeric(df).first()
    assert (d["count"], d["mean"], d["median"], d["max"]) == (2, 1.5, 1.5, 2.0)


def test_separator_and_text_keys(spark):
    from tabloom.functions.text import split_parts
    from tabloom.operators.augment import folds, split
    one = spark.createDataFrame([("a|b", "k1"), ("c", None)], "v string, k string")
    assert one.select(split_parts("v", "|").alias("p")).first()["p"] == ["a", "b"]
    keys = spark.createDataFrame([(f"key {i}",) for i in range(1000)], "k string")
    assert {r["fold"] for r in folds(keys, 5, "k").select("fold").distinct().collect()} == set(range(5))
    n = split(keys, 0.3, "k").where("split = 'train'").count()
    assert 200 < n < 400


def test_copula_sample_passes_quality(spark):
    from tabloom.operators import synth as L
    base = spark.range(2000).select(
        F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"),
        ((F.col("id") * 13) % 89 + F.col("id") % 97).cast("double").alias("b"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("c"))
    cop = L.fit_copula(base, "k")
    synth = cop.sample(spark, 2000, seed=1).drop("row_id")
    q = L.synthetic_quality(base.drop("k"), synth).first()
    assert q["overall_quality"] is True
    assert q["statistical_quality"] == 1.0


def test_permutation_keeps_multiset(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 13).alias("v"))
    p = MD.permute_column(df, "v", "k", seed=3)
    assert sorted(r[0] for r in p.select("v").collect()) == sorted(r[0] for r in df.select("v").collect())
    assert p.count() == 500


def test_fix_columns_dedupe():
    assert S.fixed_names(["a b", "a_b", "a&b", "__x__"]) == ["a_b", "a_b_1", "aandb", "x"]


def test_find_target():
    assert S.find_target(["Project_PRF_Normalised Work Effort"], "project_prf_normalised_work_effort")[0] \
        == "Project_PRF_Normalised Work Effort"
    col, similar = S.find_target(["work effort total", "x"], "normalised_work_effort")
    assert col is None and similar == ["work effort total"]


def test_drop_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    out = S.drop_duplicate_columns(df)
    assert out.columns == ["a", "b"] and out.first()[0] == 1


def test_ordered_features(spark):
    df = spark.createDataFrame([("x", 1.0, True)], "t string, n double, f boolean")
    cat = S.ordered_features(S.schema_catalog(spark, df)).orderBy("kind_rank", "position")
    assert [r["column"] for r in cat.collect()] == ["n", "t", "f"]


def test_mapping_table(spark):
    from tabloom.sources.io import mapping_table
    cfg = {"one_hot_features": {"platform": {"input_key": "p", "mapping": {"PC": "platform_pc"}}},
           "special_cases": {"team": {"input_key": "t", "output_keys": {"1": "team_1"}}}}
    got = rows(mapping_table(spark, cfg), "group", "label", "flag_column")
    assert got == [("platform", "PC", "platform_pc"), ("team", "1", "team_1")]
