"""Model, score and explanation queries.

Scored rows are lineitems: label = extended price / 1000; three literal-
coefficient models give SQL-checkable predictions; MLlib models (compare,
tune, stack, bag) run on the same rows with rows-only checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32_sql
from tabloom.operators import metrics as M
from tabloom.operators import models as MD
from tabloom.operators.augment import folds
from tabloom.plans.inputs import table, with_sql
from tabloom.plans.registry import register, rounded

PRED_COLS = ["pred_a", "pred_b", "pred_c"]

SCORED_SQL = """
scored AS (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS line_id, l_returnflag,
  l_quantity, l_discount, l_tax, l_extendedprice / 1000 AS label,
  l_quantity * 0.9 AS pred_a, l_quantity * 1.1 + 1 AS pred_b,
  l_extendedprice / 1000 * (1 - l_discount) + l_tax AS pred_c FROM lineitem)"""

# Fixed literal models used for exact checks.
MODEL_A = MD.LinearScorer("a", {"l_quantity": 0.9}, 0.0)
MODEL_B = MD.LinearScorer("b", {"l_quantity": 1.1}, 1.0)
MODEL_D = MD.LinearScorer("d", {"l_quantity": 1.2, "l_discount": -30.0, "l_tax": 20.0}, -2.0)


def scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
                     "l_returnflag", "l_quantity", "l_discount", "l_tax",
                     (F.col("l_extendedprice") / 1000).alias("label"),
                     (F.col("l_quantity") * 0.9).alias("pred_a"), (F.col("l_quantity") * 1.1 + 1).alias("pred_b"),
                     (F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount")) + F.col("l_tax")).alias("pred_c"))


def _metrics_sql(label, pred, group=None, where=None):
    e = f"({pred} - {label})"
    g = f"{group}, " if group else ""
    return (f"SELECT {g}CAST(count(*) AS BIGINT) AS n, round(avg(abs({e})), 6) AS MAE, round(avg({e} * {e}), 6) AS MSE, "
            f"round(sqrt(avg({e} * {e})), 6) AS RMSE, "
            f"round(CASE WHEN var_pop({label}) > 0 THEN 1 - sum({e} * {e}) / (count(*) * var_pop({label})) END, 6) AS R2, "
            f"round(sqrt(avg(pow(ln(1 + abs({pred})) - ln(1 + abs({label})), 2))), 6) AS RMSLE, "
            f"round(avg(CASE WHEN {label} <> 0 THEN abs({e}) / abs({label}) END), 6) AS MAPE "
            f"FROM scored{' WHERE ' + where if where else ''}{' GROUP BY ' + group if group else ''}")


@register("m05_regression_metrics", with_sql(SCORED_SQL) + "\n" + _metrics_sql("label", "pred_c"), headline=True)
def m05_regression_metrics(spark, sf_dir):
    return rounded(M.regression_metrics(scored(spark, sf_dir), "label", "pred_c"))


@register("m05_regression_metrics_by_group", with_sql(SCORED_SQL) + "\n" + _metrics_sql("label", "pred_a", "l_returnflag"))
def m05_regression_metrics_by_group(spark, sf_dir):
    return rounded(M.regression_metrics(scored(spark, sf_dir), "label", "pred_a", by=["l_returnflag"]))


FOLD_SQL = f"CAST({mix32_sql('line_id', 123)} % 10 AS INTEGER)"


@register("m06_fold_summary", with_sql(SCORED_SQL, f"""
f AS (SELECT *, {FOLD_SQL} AS fold FROM scored),
per AS (SELECT 'c' AS model, CAST(fold AS VARCHAR) AS fold, avg(abs(pred_c - label)) AS MAE,
               sqrt(avg((pred_c - label) * (pred_c - label))) AS RMSE FROM f GROUP BY fold)""") + """
SELECT model, fold, round(MAE, 6) AS MAE, round(RMSE, 6) AS RMSE FROM per
UNION ALL SELECT 'c', 'Mean', round(avg(MAE), 6), round(avg(RMSE), 6) FROM per
UNION ALL SELECT 'c', 'Std', round(stddev_pop(MAE), 6), round(stddev_pop(RMSE), 6) FROM per""")
def m06_fold_summary(spark, sf_dir):
    df = folds(scored(spark, sf_dir), 10, "line_id", seed=123)
    per = M.regression_metrics(df, "label", "pred_c", by=["fold"]).withColumn("model", F.lit("c"))
    return rounded(M.fold_summary(per, metrics=["MAE", "RMSE"]))


def _model_scores(spark, sf_dir):
    df = scored(spark, sf_dir)
    long = df.select("label", *PRED_COLS).unpivot(["label"], PRED_COLS, "model", "prediction")
    return M.regression_metrics(long, "label", "prediction", by=["model"])


MODEL_SCORES_SQL = "ms AS (" + "\nUNION ALL\n".join(
    _metrics_sql("label", p).replace("SELECT ", f"SELECT '{p}' AS model, ", 1) for p in PRED_COLS) + ")"


@register("m07_leaderboard", with_sql(SCORED_SQL, MODEL_SCORES_SQL) + "\nSELECT * FROM ms ORDER BY R2 DESC, model LIMIT 2")
def m07_leaderboard(spark, sf_dir):
    return rounded(M.leaderboard(_model_scores(spark, sf_dir), "R2", 2))


@register("m07_best_model", with_sql(SCORED_SQL, MODEL_SCORES_SQL) + """
SELECT arg_min(model, RMSE) AS best_model, min(RMSE) AS best_RMSE FROM ms""")
def m07_best_model(spark, sf_dir):
    return rounded(M.best_model(rounded(_model_scores(spark, sf_dir)), "RMSE"))


@register("m08_blend", with_sql(SCORED_SQL) + """
SELECT line_id, pred_a * (1.0 / 3) + pred_b * (1.0 / 3) + pred_c * (1.0 / 3) AS blend_mean,
       pred_a * (1.0 / 4) + pred_b * (1.0 / 4) + pred_c * (2.0 / 4) AS blend_weighted FROM scored""")
def m08_blend(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.select("line_id", M.blend(PRED_COLS).alias("blend_mean"),
                     M.blend(PRED_COLS, [1, 1, 2]).alias("blend_weighted"))


@register("m13_score_all", with_sql(SCORED_SQL, """
p AS (SELECT line_id, greatest(0.0 + l_quantity * 0.9, 0.1) AS pred_a,
             greatest(1.0 + l_quantity * 1.1, 0.1) AS pred_b,
             greatest(-2.0 + l_quantity * 1.2 + l_discount * -30.0 + l_tax * 20.0, 0.1) AS pred_d FROM scored)""") + """
SELECT line_id, pred_a, pred_b, pred_d, round((pred_a + pred_b + pred_d) / 3, 6) AS ensemble_mean,
       round(sqrt(((pred_a - (pred_a + pred_b + pred_d) / 3) ^ 2 + (pred_b - (pred_a + pred_b + pred_d) / 3) ^ 2
                  + (pred_d - (pred_a + pred_b + pred_d) / 3) ^ 2) / 3), 6) AS ensemble_std FROM p""", headline=True)
def m13_score_all(spark, sf_dir):
    df = scored(spark, sf_dir).select("line_id", "l_quantity", "l_discount", "l_tax")
    out = MD.score_all(df, [MODEL_A, MODEL_B, MODEL_D], floor=0.1)
    return rounded(out.select("line_id", "pred_a", "pred_b", "pred_d", "ensemble_mean", "ensemble_std"), 6)


@register("m14_prediction_stats", with_sql(SCORED_SQL) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{p}' AS model, CAST(count({p}) AS BIGINT) AS count, round(avg({p}), 6) AS mean, round(stddev_samp({p}), 6) AS std, "
    f"round(min({p}), 6) AS min, round(max({p}), 6) AS max, round(median({p}), 6) AS median FROM scored" for p in PRED_COLS))
def m14_prediction_stats(spark, sf_dir):
    return rounded(M.prediction_stats(scored(spark, sf_dir), PRED_COLS))


@register("m15_prediction_summary", with_sql(SCORED_SQL, """
s AS (SELECT line_id, pred_a, pred_b, pred_c, (pred_a + pred_b + pred_c) / 3 AS m FROM scored)""") + """
SELECT line_id, m AS avg, least(pred_a, pred_b, pred_c) AS min, greatest(pred_a, pred_b, pred_c) AS max,
       sqrt(((pred_a - m) * (pred_a - m) + (pred_b - m) * (pred_b - m) + (pred_c - m) * (pred_c - m)) / 3) AS std,
       CAST(sqrt(((pred_a - m) * (pred_a - m) + (pred_b - m) * (pred_b - m) + (pred_c - m) * (pred_c - m)) / 3) > m * 0.3 AS INTEGER) AS high_variance
FROM s""")
def m15_prediction_summary(spark, sf_dir):
    return M.prediction_summary(scored(spark, sf_dir), PRED_COLS, "line_id")


WHAT_IF_VALUES = [1.0, 10.0, 25.0, 50.0]


@register("m16_what_if", with_sql(SCORED_SQL) + f"""
SELECT line_id, CAST(s.step AS INTEGER) AS step, CAST(v.q AS DOUBLE) AS l_quantity,
       round(-2.0 + v.q * 1.2 + l_discount * -30.0 + l_tax * 20.0, 6) AS prediction
FROM scored CROSS JOIN (SELECT unnest(range(4)) AS step) s
JOIN (SELECT unnest(range(4)) AS step, unnest({WHAT_IF_VALUES}) AS q) v ON s.step = v.step""")
def m16_what_if(spark, sf_dir):
    df = scored(spark, sf_dir).select("line_id", "l_quantity", "l_discount", "l_tax")
    out = MD.what_if(df, "l_quantity", WHAT_IF_VALUES, MODEL_D)
    return rounded(out.select("line_id", F.col("step").cast("int").alias("step"), "l_quantity", "prediction"))


GRID_SQL = """
base AS (SELECT o_orderkey, o_totalprice / 10000 AS size FROM orders),
rng AS (SELECT o_orderkey, size,
  CASE WHEN size IS NULL OR least(50.0, size * 2.0) - greatest(1.0, size * 0.5) < (50.0 - 1.0) * 0.1 THEN 1.0 ELSE greatest(1.0, size * 0.5) END AS lo,
  CASE WHEN size IS NULL OR least(50.0, size * 2.0) - greatest(1.0, size * 0.5) < (50.0 - 1.0) * 0.1 THEN 50.0 ELSE least(50.0, size * 2.0) END AS hi
  FROM base),
g AS (SELECT o_orderkey, size, lo, hi, CAST(step AS INTEGER) AS step,
  CASE WHEN step = 14 THEN hi ELSE lo + step * ((hi - lo) / 14) END AS value
  FROM rng CROSS JOIN (SELECT unnest(range(15)) AS step))"""


def _grid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("size"))
    g = MD.what_if_grid(o, "size", 1.0, 50.0, 15)
    size_model = MD.LinearScorer("size", {"value": 12.5}, 40.0)
    return size_model.predict(g, "prediction")


@register("m17_what_if_grid", with_sql(GRID_SQL) + """
SELECT o_orderkey, step, value, 40.0 + value * 12.5 AS prediction FROM g""")
def m17_what_if_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("o_orderkey", F.col("step").cast("int").alias("step"), "value", "prediction")


@register("m17_what_if_summary", with_sql(GRID_SQL) + """
SELECT o_orderkey, min(40.0 + value * 12.5) AS min_prediction, max(40.0 + value * 12.5) AS max_prediction,
       greatest(max(40.0 + value * 12.5) - min(40.0 + value * 12.5), 0.0) AS impact,
       CASE WHEN max(40.0 + value * 12.5) - min(40.0 + value * 12.5) > 0
            THEN (max(40.0 + value * 12.5) - min(40.0 + value * 12.5)) / (max(hi) - max(lo)) END AS sensitivity
FROM g GROUP BY o_orderkey""")
def m17_what_if_summary(spark, sf_dir):
    return MD.what_if_summary(_grid(spark, sf_dir), "o_orderkey")


CANDIDATES = [0.1, 0.2, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


@register("m18_pick_candidate", with_sql("""
base AS (SELECT o_orderkey, o_totalprice FROM orders),
ex AS (SELECT o_orderkey, pos, c, o_totalprice / 100 * c AS pred FROM base CROSS JOIN
       (SELECT unnest(range(8)) AS pos, unnest([0.1, 0.2, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]) AS c)),
kept AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS r,
                count(*) OVER (PARTITION BY o_orderkey) AS n FROM ex WHERE pred >= 10 AND pred <= 5000)""") + """
SELECT o_orderkey, CAST(c AS DOUBLE) AS chosen_value, round(pred, 6) AS chosen_prediction, CAST(n AS INTEGER) AS n_valid
FROM kept WHERE r = floor(n / 2) + 1""")
def m18_pick_candidate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(0.0).alias("target"))
    model = _ProductScorer()
    return rounded(M.pick_candidate(o, "o_orderkey", CANDIDATES, "target", model))


class _ProductScorer:
    """A model of the form price/100 * target (non-additive, expression-backed)."""
    name = "product"

    def predict(self, df, out="prediction"):
        return df.withColumn(out, F.col("o_totalprice") / 100 * F.col("target"))


IMP_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _importance_table(spark, sf_dir):
    df = scored(spark, sf_dir)
    g = df.groupBy("l_returnflag").agg(*[F.abs(F.corr(f, "label")).alias(f) for f in IMP_FEATURES])
    long = g.unpivot(["l_returnflag"], IMP_FEATURES, "feature", "importance")
    return long.select(F.concat(F.lit("model_"), F.col("l_returnflag")).alias("model"), "feature", "importance")


@register("m20_compare_importance", with_sql(SCORED_SQL, """
imp AS (SELECT 'model_' || l_returnflag AS model, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
               unnest([abs(corr(l_quantity, label)), abs(corr(l_discount, label)), abs(corr(l_tax, label))]) AS importance
        FROM scored GROUP BY l_returnflag)""") + """
SELECT feature, coalesce(round(max(importance) FILTER (model = 'model_A'), 6), 0) AS model_A, coalesce(round(max(importance) FILTER (model = 'model_N'), 6), 0) AS model_N,
       coalesce(round(max(importance) FILTER (model = 'model_R'), 6), 0) AS model_R, round(avg(importance), 6) AS mean_importance
FROM imp GROUP BY feature ORDER BY mean_importance DESC, feature LIMIT 10""")
def m20_compare_importance(spark, sf_dir):
    """The whole pivot: a column for each model, the ten first features by mean."""
    return rounded(M.compare_importance(_importance_table(spark, sf_dir), n=10))


@register("m22_linear_attribution", with_sql(SCORED_SQL) + """
SELECT line_id, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
       round(unnest([(l_quantity - (SELECT avg(l_quantity) FROM scored)) * 1.2,
                     (l_discount - (SELECT avg(l_discount) FROM scored)) * -30.0,
                     (l_tax - (SELECT avg(l_tax) FROM scored)) * 20.0]), 6) AS value
FROM scored""")
def m22_linear_attribution(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(MD.linear_attribution(df, MODEL_D, "line_id"))


@register("m22_attribution_ranking", with_sql(SCORED_SQL) + """
SELECT 'l_quantity' AS feature, round(avg(abs((l_quantity - (SELECT avg(l_quantity) FROM scored)) * 1.2)), 6) AS mean_abs FROM scored
UNION ALL SELECT 'l_discount', round(avg(abs((l_discount - (SELECT avg(l_discount) FROM scored)) * -30.0)), 6) FROM scored
UNION ALL SELECT 'l_tax', round(avg(abs((l_tax - (SELECT avg(l_tax) FROM scored)) * 20.0)), 6) FROM scored""")
def m22_attribution_ranking(spark, sf_dir):
    return rounded(MD.attribution_ranking(MD.linear_attribution(scored(spark, sf_dir), MODEL_D, "line_id")))


@register("m22_breakdown", with_sql(SCORED_SQL, "one AS (SELECT * FROM scored WHERE line_id = (SELECT min(line_id) FROM scored))") + """
SELECT '(mean)' AS feature, CAST(NULL AS DOUBLE) AS input,
       round(-2.0 + (SELECT avg(l_quantity) FROM scored) * 1.2 + (SELECT avg(l_discount) FROM scored) * -30.0
             + (SELECT avg(l_tax) FROM scored) * 20.0, 6) AS value FROM one
UNION ALL SELECT 'l_quantity', l_quantity, round((l_quantity - (SELECT avg(l_quantity) FROM scored)) * 1.2, 6) FROM one
UNION ALL SELECT 'l_discount', l_discount, round((l_discount - (SELECT avg(l_discount) FROM scored)) * -30.0, 6) FROM one
UNION ALL SELECT 'l_tax', l_tax, round((l_tax - (SELECT avg(l_tax) FROM scored)) * 20.0, 6) FROM one""")
def m22_breakdown(spark, sf_dir):
    """How one row's prediction comes about."""
    df = scored(spark, sf_dir)
    first = df.agg(F.min("line_id")).first()[0]
    return rounded(MD.attribution_breakdown(df, MODEL_D, "line_id", first))


@register("m22_dependence_pairs", with_sql(SCORED_SQL) + """
SELECT line_id, 'l_quantity' AS feature, l_quantity AS input, round((l_quantity - (SELECT avg(l_quantity) FROM scored)) * 1.2, 6) AS value FROM scored
UNION ALL SELECT line_id, 'l_discount', l_discount, round((l_discount - (SELECT avg(l_discount) FROM scored)) * -30.0, 6) FROM scored""")
def m22_dependence_pairs(spark, sf_dir):
    """Inputs and attributions of the two features that matter most."""
    return rounded(MD.dependence_pairs(scored(spark, sf_dir), MODEL_D, "line_id", 2))


@register("m23_residuals", with_sql(SCORED_SQL) + """
SELECT line_id, label - pred_c AS residual, abs(label - pred_c) AS abs_error,
       CASE WHEN label <> 0 THEN (label - pred_c) / label END AS relative_error FROM scored""")
def m23_residuals(spark, sf_dir):
    return M.residuals(scored(spark, sf_dir), "label", "pred_c").select("line_id", "residual", "abs_error",
                                                                        "relative_error")


@register("m24_ols", with_sql(SCORED_SQL) + """
SELECT 'intercept' AS term, round(regr_intercept(label, l_quantity), 6) AS value FROM scored
UNION ALL SELECT 'l_quantity', round(regr_slope(label, l_quantity), 6) FROM scored""")
def m24_ols(spark, sf_dir):
    m = MD.ols(scored(spark, sf_dir), "label", ["l_quantity"])
    rows = [("intercept", m.intercept)] + list(m.coefs.items())
    return rounded(spark.createDataFrame(rows, "term string, value double"))


@register("m26_dummy", with_sql(SCORED_SQL) + """
SELECT line_id, round((SELECT avg(label) FROM scored), 6) AS prediction FROM scored""")
def m26_dummy(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(MD.dummy(df, "label").predict(df.select("line_id"), "prediction"))


HIST_SQL = """
hist AS (SELECT ts AS timestamp, event_type AS model, value * 10 AS prediction_hours,
                CAST(user_id % 10 AS INTEGER) AS team_size FROM events)"""


def _hist(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("model"),
                    (F.col("value") * 10).alias("prediction_hours"), (F.col("user_id") % 10).cast("int").alias("team_size"))


@register("m27_history_table", with_sql(HIST_SQL) + """
SELECT CAST(row_number() OVER (ORDER BY timestamp, model, prediction_hours, team_size) AS INTEGER) AS n,
       timestamp, model, prediction_hours, prediction_hours / 8 AS days, team_size FROM hist""")
def m27_history_table(spark, sf_dir):
    return M.history_table(_hist(spark, sf_dir))


@register("m27_history_summary", with_sql(HIST_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS total, round(avg(prediction_hours), 6) AS average, min(prediction_hours) AS min,
       max(prediction_hours) AS max, max(prediction_hours) - min(prediction_hours) AS range,
       round(stddev_pop(prediction_hours), 6) AS std FROM hist""")
def m27_history_summary(spark, sf_dir):
    return rounded(M.history_summary(_hist(spark, sf_dir)))


@register("m27_history_last", with_sql(HIST_SQL) + "\nSELECT * FROM hist ORDER BY timestamp DESC, model, prediction_hours, team_size LIMIT 3")
def m27_history_last(spark, sf_dir):
    return M.history_last(_hist(spark, sf_dir), 3)


# --- MLlib-backed (rows-only checks; properties in tests) --------------------
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _train(spark, sf_dir):
    return scored(spark, sf_dir).select("line_id", "label", *FEATURES)


@register("m01_prepare")
def m01_prepare(spark, sf_dir):
    from tabloom.plans.modelprep import prepare
    from tabloom.plans.inputs import project_frame
    df = project_frame(spark, sf_dir)
    prepared = prepare(df, "effort", ignore=["project_id", "part_brands", "part_types"], normalize=True)
    return prepared.transform(df).select("project_id", "effort", "features")


@register("m02_compare_models")
def m02_compare_models(spark, sf_dir):
    """All eleven algorithms, ten folds."""
    folds_df, top = MD.compare_models(_train(spark, sf_dir), "label", FEATURES, "line_id",
                                      [*MD.ALGORITHMS, "ols", "dummy", "knn"], k=10, sort="R2", n_select=3)
    return folds_df


@register("m03_fit_model")
def m03_fit_model(spark, sf_dir):
    df = _train(spark, sf_dir)
    m = MD.fit_model(df, "label", FEATURES, "gbr")
    return m.predict(df, "prediction").select("line_id", "label", "prediction")


@register("m04_tune")
def m04_tune(spark, sf_dir):
    best, table_ = MD.tune(_train(spark, sf_dir), "label", FEATURES, "line_id", "dt",
                           {"maxDepth": [2, 3, 4, 5, 6], "minInstancesPerNode": [1, 5, 20, 50]}, n_iter=10, k=10)
    return table_


@register("m09_stack")
def m09_stack(spark, sf_dir):
    df = _train(spark, sf_dir)
    bases, meta = MD.stack(df, "label", FEATURES, "line_id", ["lr", "dt"], k=10)
    return MD.stack_predict(df, bases, meta).select("line_id", "label", "prediction")


@register("m10_bag")
def m10_bag(spark, sf_dir):
    df = _train(spark, sf_dir)
    models = MD.bag(df, "label", FEATURES, "line_id", "dt", n=10)
    return MD.bag_predict(df, models).select("line_id", "label", "prediction")


@register("m11_finalize", with_sql(SCORED_SQL) + """
SELECT line_id, round((SELECT regr_intercept(label, l_quantity) FROM scored)
                      + (SELECT regr_slope(label, l_quantity) FROM scored) * l_quantity, 6) AS prediction
FROM scored""")
def m11_finalize(spark, sf_dir):
    """Refit on all rows (Spark ML LinearRegression, normal equations) and score."""
    df = _train(spark, sf_dir)
    m = MD.finalize(df, "label", ["l_quantity"], "lr")
    return rounded(m.predict(df, "prediction").select("line_id", "prediction"))


def _saved_models(spark, sf_dir):
    from tabloom.session import checkpoint_dir
    import uuid
    root = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    df = _train(spark, sf_dir)
    fitted = [MD.fit_model(df, "label", FEATURES, spec) for spec in ("lr", "dt", "ols")]
    scores = MD.scores_side_by_side(df, fitted, "label")
    paths = []
    for rank, m in enumerate(fitted, 1):
        MD.save_model(m, f"{root}/{m.name}", rank, {"R2": scores[m.name]["R2"], "RMSE": scores[m.name]["RMSE"]})
        paths.append(f"{root}/{m.name}")
    return paths


@register("m12_model_registry")
def m12_model_registry(spark, sf_dir):
    paths = _saved_models(spark, sf_dir)
    reg = MD.model_registry(spark, paths)
    loaded = [MD.load_model(p) for p in paths]
    df = _train(spark, sf_dir)
    scoredf = MD.score_all(df, loaded, floor=None)
    return reg.select("name", "rank").crossJoin(scoredf.agg(F.count(F.lit(1)).alias("rows_scored")))


@register("m19_importance")
def m19_importance(spark, sf_dir):
    df = _train(spark, sf_dir)
    ms = [MD.fit_model(df, "label", FEATURES, s) for s in ["lr", "rf", "ols"]]
    return MD.importance(spark, ms)


@register("m21_permutation_importance")
def m21_permutation_importance(spark, sf_dir):
    df = _train(spark, sf_dir)
    return MD.permutation_importance(df, MODEL_D, "label", FEATURES, "line_id", n=10)


@register("m28_registry_check")
def m28_registry_check(spark, sf_dir):
    """Each saved model with its status, features and files (sizes depend on the writer: only their presence)."""
    checked = MD.check_models(spark, _saved_models(spark, sf_dir), FEATURES)
    return checked.select("name", "status", "loaded", "n_features", "n_expected", (F.col("bytes") > 0).alias("has_files"))
