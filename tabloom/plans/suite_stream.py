"""Streaming (S01, S02) and source/sink (A01-A04, A08, A09) queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.operators import models as MD
from tabloom.operators.encode import OneHot
from tabloom.plans.inputs import table
from tabloom.plans.registry import register, rounded
from tabloom.session import checkpoint_dir
from tabloom.sources import io as A
from tabloom.streaming import scoring as S

MODEL_D = MD.LinearScorer("d", {"l_quantity": 1.2, "l_discount": -30.0, "l_tax": 20.0}, -2.0)


@register("s01_score_stream", """
SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A,
       CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R,
       -2.0 + l_quantity * 1.2 + l_discount * -30.0 + l_tax * 20.0 AS pred_d
FROM lineitem""", headline=True)
def s01_score_stream(spark, sf_dir):
    """Lineitems arrive as a file stream; a one-hot plan fitted on the batch
    table and a linear scorer are applied per micro-batch (stream = batch)."""
    batch = table(spark, sf_dir, "lineitem")
    onehot = OneHot(10).fit(batch.select("l_returnflag"))

    def prepare(df):
        return onehot.transform(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                          "l_returnflag"))
    out = S.score_stream(spark, sf_dir, batch.schema, prepare, [MODEL_D], name="s01", glob="lineitem.parquet")
    return out.select("l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "pred_d")


@register("s02_windowed_summary", """
WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS model, value * 10 AS p FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end,
       model, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean, min(p) AS min, max(p) AS max
FROM e GROUP BY window_start, model""")
def s02_windowed_summary(spark, sf_dir):
    """Events read as a stream; per model (event type) and hour: count, mean,
    min, max of the prediction; append mode with a 10 minute watermark, and the
    windows still open at the end."""
    ev = table(spark, sf_dir, "events")

    def predicted(df):
        return df.select("ts", "event_type", (F.col("value") * 10).alias("p"))
    stream = S.read_stream(spark, sf_dir, ev.schema, glob="events.parquet")
    out = S.run_to_sink(S.windowed_summary(predicted(stream), "ts", "event_type", "p"), spark, "s02")
    return rounded(S.with_open_windows(out, predicted(ev), "ts", "event_type", "p"))


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/io/{name}-{uuid.uuid4().hex}"


@register("a01_csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def a01_csv_roundtrip(spark, sf_dir):
    """Write orders as CSV with a header, read back with inferred types."""
    path = _scratch(spark, "orders_csv")
    src = table(spark, sf_dir, "orders")
    A.write_table(src, path, fmt="csv")
    back = A.read_table(spark, path, fmt="csv")
    # inferred types can be narrower than the source's (int keys): restore them
    return back.select(*[F.col(f.name).cast(f.dataType) for f in src.schema.fields])


@register("a02_parquet_scan", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000""")
def a02_parquet_scan(spark, sf_dir):
    """Parquet scan with column pruning and pushed filters."""
    o = A.read_table(spark, f"{sf_dir}/orders.parquet")
    return o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000)).select(
        "o_orderkey", "o_totalprice")


@register("a04_prediction_sink", """
SELECT l_orderkey, l_linenumber, l_returnflag, -2.0 + l_quantity * 1.2 + l_discount * -30.0 + l_tax * 20.0 AS prediction
FROM lineitem""")
def a04_prediction_sink(spark, sf_dir):
    """Scored rows written as Parquet partitioned by return flag, read back."""
    path = _scratch(spark, "predictions")
    li = table(spark, sf_dir, "lineitem")
    scoredf = MODEL_D.predict(li, "prediction").select("l_orderkey", "l_linenumber", "l_returnflag", "prediction")
    A.write_table(scoredf, path, partition_by=["l_returnflag"])
    return A.read_table(spark, path)


@register("a08_feature_lists", """
SELECT * FROM (VALUES ('lr', 0, 'l_quantity'), ('lr', 1, 'l_discount'), ('ols', 0, 'l_quantity'), ('ols', 1, 'l_tax'),
  ('__all__', 0, 'l_quantity'), ('__all__', 1, 'l_discount'), ('__all__', 2, 'l_tax')) t(model, feature_index, feature)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def a08_feature_lists(spark, sf_dir):
    """Feature lists of models fitted on lineitems, plus the master list."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("label"), "l_quantity",
                                                 "l_discount", "l_tax")
    lr = MD.fit_model(li, "label", ["l_quantity", "l_discount"], "lr")
    ol = MD.fit_model(li, "label", ["l_quantity", "l_tax"], "ols")
    return A.feature_lists(spark, {"lr": lr.features, "ols": list(ol.coefs)})


@register("a09_category_listing", """
SELECT 'c_mktsegment' AS "column", (SELECT CAST(count(DISTINCT c_mktsegment) AS BIGINT) FROM customer) AS n_unique, c_mktsegment AS value
FROM (SELECT DISTINCT c_mktsegment FROM customer)
UNION ALL
SELECT 'c_name', (SELECT CAST(count(DISTINCT c_name) AS BIGINT) FROM customer), c_name FROM (SELECT DISTINCT c_name FROM customer)""")
def a09_category_listing(spark, sf_dir):
    return A.category_listing(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"])


@register("a03_write_table", __import__("tabloom.plans.suite_core", fromlist=["PREPROCESS_SQL"]).PREPROCESS_SQL)
def a03_write_table(spark, sf_dir):
    """The processed table written as CSV (header) and read back with its schema."""
    from tabloom.plans.suite_core import preprocessed
    out = preprocessed(spark, sf_dir)[1]
    path = _scratch(spark, "processed_csv")
    A.write_table(out, path, fmt="csv")
    return A.read_table(spark, path, fmt="csv", schema=out.schema)


@register("b10_compare_saved_features", """
SELECT * FROM (VALUES ('l_quantity', 'valid'), ('l_discount', 'extra'), ('l_tax', 'missing')) t(feature, status)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def b10_compare_saved_features(spark, sf_dir):
    """Feature sets of two fitted forms of a model (ML pipeline vs one-pass OLS)."""
    from tabloom.operators.schema import compare_features
    li = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("label"), "l_quantity",
                                                 "l_discount", "l_tax")
    lr = MD.fit_model(li, "label", ["l_quantity", "l_discount"], "lr")
    ol = MD.fit_model(li, "label", ["l_quantity", "l_tax"], "ols")
    a = spark.createDataFrame([(f,) for f in lr.features], "feature string")
    b = spark.createDataFrame([(f,) for f in ol.coefs], "feature string")
    return compare_features(a, b)
