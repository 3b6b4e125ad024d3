"""Fitted-plan queries: preserving plan (X03), score-time preparation
and plan save/load (X07), checked against the same SQL as the flow (X04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.plans import sqltext as T
from tabloom.plans.inputs import PROJECT_SQL, raw_project_frame, with_sql
from tabloom.plans.preprocess import FittedPreprocessor, Preprocessor, prepare_for_model
from tabloom.plans.registry import register
from tabloom.plans.suite_core import PREPROCESS_SQL, TARGET, _clean, preprocessed
from tabloom.session import checkpoint_dir, materialize


@register("x03_preserve", PREPROCESS_SQL.replace(
    "SELECT project_id, normalised_work_effort, acct_balance, order_year, nation, part_brands,",
    "SELECT project_id, normalised_work_effort, acct_balance, order_year, order_priority, nation, part_brands,", 1))
def x03_preserve(spark, sf_dir):
    """Preserving plan: the encoded column is kept beside its flags."""
    raw = materialize(raw_project_frame(spark, sf_dir))
    fitted = Preprocessor(TARGET, preserve=["order_priority"]).fit(raw)
    return fitted.transform(raw)


X05_SQL = PREPROCESS_SQL.replace(
    "coalesce(acct_balance, (SELECT median(acct_balance) FROM proj)) AS acct_balance,",
    "coalesce(acct_balance, (SELECT median(acct_balance) FROM proj)) AS acct_balance,\n"
    "         coalesce(sparse_metric, (SELECT median(sparse_metric) FROM proj)) AS sparse_metric_k,", 1).replace(
    "SELECT project_id, normalised_work_effort, acct_balance, order_year, nation, part_brands,",
    "SELECT project_id, acct_balance, sparse_metric_k, order_year, nation, part_brands,", 1)


@register("x05_prediction_preprocess", X05_SQL)
def x05_prediction_preprocess(spark, sf_dir):
    """Prediction-time settings (threshold 0.9, cardinality 20) then the
    leak-word drop: the 90 %-missing column sits exactly at the threshold and
    is kept (the test is strictly greater)."""
    from tabloom.operators.schema import drop_by_keyword
    raw = materialize(raw_project_frame(spark, sf_dir))
    fitted = Preprocessor(TARGET, threshold=0.9, max_cardinality=20).fit(raw)
    return drop_by_keyword(fitted.transform(raw))


EXPECTED = ["acct_balance", "order_year", "order_priority_1_urgent", "market_segment_building", "region_asia",
            "part_types_promo", "team_size"]


@register("x06_prepare_for_model", with_sql(PROJECT_SQL, f"""
base AS (SELECT coalesce(acct_balance, (SELECT median(acct_balance) FROM proj)) AS acct_balance, order_year,
                {_clean('priority')} AS pr, {_clean('segment')} AS seg, {_clean('region')} AS reg,
                {T.tidy(_clean('part_types'))} AS pt FROM proj)""") + f"""
SELECT acct_balance, CAST(order_year AS DOUBLE) AS order_year,
       CAST({T.flag("pr = '1_urgent'")} AS DOUBLE) AS order_priority_1_urgent,
       CAST({T.flag("seg = 'building'")} AS DOUBLE) AS market_segment_building,
       CAST({T.flag("reg = 'asia'")} AS DOUBLE) AS region_asia,
       CAST({T.flag(f"list_contains({T.parts('pt')}, 'promo')")} AS DOUBLE) AS part_types_promo,
       CAST(0.0 AS DOUBLE) AS team_size
FROM base""")
def x06_prepare_for_model(spark, sf_dir):
    """Score-time preparation: fitted transform (no refit), leak-word drop,
    numeric coercion and alignment to a model's expected feature list."""
    raw, _, fitted = preprocessed(spark, sf_dir)
    return prepare_for_model(raw, fitted, EXPECTED)


@register("x07_plan_roundtrip", PREPROCESS_SQL)
def x07_plan_roundtrip(spark, sf_dir):
    """Fitted plan saved as JSON under the shared folder, loaded, applied."""
    import uuid
    raw, _, fitted = preprocessed(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/plans/preprocess-{uuid.uuid4().hex}"
    fitted.save(spark, path)
    return FittedPreprocessor.load(spark, path).transform(raw)


@register("m25_knn_predict")
def m25_knn_predict(spark, sf_dir):
    """k-NN mean prediction for status-O lineitems from status-F lineitems
    (exact; brute force on whole tables is quadratic, so it is tested against
    brute force on fixtures)."""
    from tabloom.operators.knn import knn_predict
    from tabloom.plans.inputs import table
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), "l_linestatus", "l_quantity",
        (F.col("l_discount") * 100).alias("discount_pct"), (F.col("l_extendedprice") / 1000).alias("label"))
    train = li.where(F.col("l_linestatus") == "F")
    test = li.where(F.col("l_linestatus") == "O").select("line_id", "l_quantity", "discount_pct")
    return knn_predict(train, test, ["l_quantity", "discount_pct"], "label", "line_id", k=5)
