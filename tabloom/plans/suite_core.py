"""Minimum slice: the preprocessing flow end to end (X01-X04, A05, E17) and the
schema/name operators that it is made of (B01-B19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import schema as S
from tabloom.operators.profile import validate_table
from tabloom.plans import sqltext as T
from tabloom.plans.inputs import (PART_TYPES, PRIORITIES, PROJECT_SQL, RAW_HEADERS, REGIONS, SEGMENTS,
                                  STATUSES, project_frame, raw_project_frame, table, with_sql)
from tabloom.plans.preprocess import Preprocessor, processing_report
from tabloom.plans.registry import register, rounded
from tabloom.session import materialize

TARGET = "normalised_work_effort"


def _lv(values, drop=()):
    out = sorted({v.lower().replace("-", "_") for v in values} - set(drop))
    return out


# Learned plan of the flow on the test tables (levels are TPC-H constants).
PRIORITY_LEVELS = _lv(PRIORITIES, {"5_low"}) + ["missing"]
SEGMENT_LEVELS = _lv(SEGMENTS)
STATUS_LEVELS = _lv(STATUSES)
REGION_LEVELS = _lv(REGIONS)
TYPE_LEVELS = sorted(_lv(PART_TYPES) + ["missing"])


def _clean(e: str) -> str:
    return T.clean_value(f"coalesce({T.strip(f'lower({e})')}, 'missing')")


PREPROCESS_SQL = with_sql(PROJECT_SQL, f"""
base AS (
  SELECT project_id,
         effort AS normalised_work_effort,
         coalesce(acct_balance, (SELECT median(acct_balance) FROM proj)) AS acct_balance,
         order_year,
         {_clean('priority')} AS order_priority,
         {_clean('segment')} AS market_segment,
         {_clean('status')} AS order_status,
         {_clean('region')} AS region,
         {_clean('nation')} AS nation,
         {T.tidy(_clean('part_types'))} AS part_types,
         {T.tidy(_clean('part_brands'))} AS part_brands
  FROM proj
)""") + f"""
SELECT project_id, normalised_work_effort, acct_balance, order_year, nation, part_brands,
  {", ".join(f"{T.flag(f'list_contains({T.parts('part_types')}, ' + repr(v) + ')')} AS {T.fixed_name('part_types__' + v)}" for v in TYPE_LEVELS)},
  {", ".join(f"{T.flag(f'order_priority = ' + repr(v))} AS {T.fixed_name('order_priority_' + v)}" for v in PRIORITY_LEVELS)},
  {", ".join(f"{T.flag(f'market_segment = ' + repr(v))} AS {T.fixed_name('market_segment_' + v)}" for v in SEGMENT_LEVELS)},
  {", ".join(f"{T.flag(f'order_status = ' + repr(v))} AS {T.fixed_name('order_status_' + v)}" for v in STATUS_LEVELS)},
  {", ".join(f"{T.flag(f'region = ' + repr(v))} AS {T.fixed_name('region_' + v)}" for v in REGION_LEVELS)}
FROM base"""


def preprocessed(spark, sf_dir):
    # the derived input is scanned by three fit jobs and the transform: cut lineage once
    raw = materialize(raw_project_frame(spark, sf_dir))
    fitted = Preprocessor(TARGET).fit(raw)
    return raw, fitted.transform(raw), fitted


@register("x04_preprocess", PREPROCESS_SQL, headline=True)
def x04_preprocess(spark, sf_dir):
    return preprocessed(spark, sf_dir)[1]


@register("e17_validate_table", with_sql(PROJECT_SQL) + f"""
SELECT CAST(count(*) AS BIGINT) AS rows, 12 AS columns,
  CAST(count(*) - count(project_id) + count(*) - count(effort) + count(*) - count(acct_balance)
     + count(*) - count(sparse_metric) + count(*) - count(order_year) + count(*) - count(priority)
     + count(*) - count(segment) + count(*) - count(status) + count(*) - count(region)
     + count(*) - count(nation) + count(*) - count(part_types) + count(*) - count(part_brands) AS BIGINT) AS missing_total,
  CAST(0 AS BIGINT) AS infinite_total, 5 AS numeric_columns, 7 AS categorical_columns,
  CAST(count(effort) AS BIGINT) AS target_count, round(avg(effort), 4) AS target_mean
FROM proj""", headline=True)
def e17_validate_table(spark, sf_dir):
    return rounded(validate_table(project_frame(spark, sf_dir), "effort"), 4)


@register("a05_processing_report", with_sql(PROJECT_SQL) + f"""
SELECT CAST(count(*) AS BIGINT) AS original_rows, 12 AS original_columns,
       CAST(count(*) AS BIGINT) AS processed_rows,
       {6 + len(TYPE_LEVELS) + len(PRIORITY_LEVELS) + len(SEGMENT_LEVELS) + len(STATUS_LEVELS) + len(REGION_LEVELS)} AS processed_columns,
       true AS target_found,
       '{"; ".join(__import__("tabloom.plans.preprocess", fromlist=["STEPS"]).STEPS)}' AS steps
FROM proj""")
def a05_processing_report(spark, sf_dir):
    raw, out, _ = preprocessed(spark, sf_dir)
    return processing_report(raw, out, TARGET, with_timestamp=False)


@register("x08_output_columns", f"""
SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(
    ['project_id', 'normalised_work_effort', 'acct_balance', 'order_year', 'nation', 'part_brands']
    + [T.fixed_name('part_types__' + v) for v in TYPE_LEVELS]
    + [T.fixed_name('order_priority_' + v) for v in PRIORITY_LEVELS]
    + [T.fixed_name('market_segment_' + v) for v in SEGMENT_LEVELS]
    + [T.fixed_name('order_status_' + v) for v in STATUS_LEVELS]
    + [T.fixed_name('region_' + v) for v in REGION_LEVELS]))}) t(position, feature)""")
def x08_output_columns(spark, sf_dir):
    """Expected output columns of the fitted plan, checked against the plan fitted on the tables."""
    _, _, fitted = preprocessed(spark, sf_dir)
    cols = fitted.output_columns()
    return spark.createDataFrame(list(enumerate(cols)), "position int, feature string")


# --- B: schema operators on the project frame ---------------------------------
# The names that both naming contracts give the raw headers.
CLEAN_HEADERS = {
    'Project ID': 'project_id',
    'Normalised Work Effort': 'normalised_work_effort',
    ' Acct Balance': 'acct_balance',
    'Sparse Metric (k)': 'sparse_metric_k',
    'Order Year': 'order_year',
    'Order Priority': 'order_priority',
    'Market Segment': 'market_segment',
    'Order Status': 'order_status',
    'Region': 'region',
    'Nation': 'nation',
    'Part Types': 'part_types',
    'Part Brands': 'part_brands',
}


def _renamed_sql(names) -> str:
    cols = ", ".join(f'{c} AS "{names[h]}"' for c, h in RAW_HEADERS.items())
    return with_sql(PROJECT_SQL) + f"\nSELECT {cols} FROM proj"


@register("b01_find_target", with_sql(PROJECT_SQL) + """
SELECT project_id AS "Project ID", effort AS normalised_work_effort FROM proj""")
def b01_find_target(spark, sf_dir):
    """The target found under another spelling and selected under its own name."""
    df = raw_project_frame(spark, sf_dir)
    found, _ = S.find_target(df.columns, "normalised_work_effort")
    return df.select(S.q("Project ID"), S.q(found).alias("normalised_work_effort"))


@register("b02_standardize_columns", _renamed_sql(CLEAN_HEADERS))
def b02_standardize_columns(spark, sf_dir):
    return S.standardize_columns(raw_project_frame(spark, sf_dir))


@register("b05_clean_and_fix_columns", _renamed_sql(CLEAN_HEADERS))
def b05_clean_and_fix_columns(spark, sf_dir):
    return S.fix_columns(S.clean_columns(raw_project_frame(spark, sf_dir)))


@register("b06_drop_duplicate_columns", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def b06_drop_duplicate_columns(spark, sf_dir):
    """A frame in which a join doubled the key keeps its first copy."""
    o = table(spark, sf_dir, "orders")
    doubled = o.select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string").alias("o_orderstatus"), "o_totalprice",
                       F.col("o_custkey").alias("o_orderkey"))
    return S.drop_duplicate_columns(doubled)


@register("b07_align_columns", with_sql(PROJECT_SQL) + """
SELECT project_id, effort, 0 AS team_size, acct_balance FROM proj""")
def b07_align_columns(spark, sf_dir):
    return S.align_columns(project_frame(spark, sf_dir), ["project_id", "effort", "team_size", "acct_balance"])


@register("b08_numeric_vector", with_sql(PROJECT_SQL) + """
SELECT project_id, coalesce(CAST(effort AS DOUBLE), 0.0) AS effort,
       coalesce(acct_balance, 0.0) AS acct_balance,
       coalesce(TRY_CAST(status AS DOUBLE), 0.0) AS status,
       CAST(0.0 AS DOUBLE) AS team_size,
       coalesce(CAST(order_year AS DOUBLE), 0.0) AS order_year
FROM proj""")
def b08_numeric_vector(spark, sf_dir):
    return S.numeric_vector(project_frame(spark, sf_dir), ["effort", "acct_balance", "status", "team_size",
                                                           "order_year"], keep=["project_id"])


@register("b09_compare_features", """
WITH provided AS (SELECT DISTINCT lower(p_type) AS feature FROM part),
expected AS (SELECT unnest(['economy', 'small', 'medium', 'tiny', 'huge']) AS feature)
SELECT coalesce(p.feature, e.feature) AS feature,
       CASE WHEN p.feature IS NULL THEN 'missing' WHEN e.feature IS NULL THEN 'extra' ELSE 'valid' END AS status
FROM provided p FULL OUTER JOIN expected e ON p.feature = e.feature""")
def b09_compare_features(spark, sf_dir):
    """Feature names provided by the data (distinct part types) against an expected list."""
    provided = table(spark, sf_dir, "part").select(F.lower("p_type").alias("feature"))
    expected = spark.createDataFrame([(c,) for c in ["economy", "small", "medium", "tiny", "huge"]],
                                     "feature string")
    return S.compare_features(provided, expected)


@register("b13_drop_by_keyword", with_sql(PROJECT_SQL) + """
SELECT project_id, acct_balance, sparse_metric, order_year, priority, segment, status, region, nation,
       part_types, part_brands FROM proj""")
def b13_drop_by_keyword(spark, sf_dir):
    return S.drop_by_keyword(project_frame(spark, sf_dir))


@register("b15_drop_constant", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem""")
def b15_drop_constant(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
        F.lit("x").alias("const_text"), F.lit(None).cast("double").alias("all_null"),
        F.when(F.col("l_orderkey") < 0, F.lit(1.0)).alias("one_value_or_null"))
    return S.drop_constant(li)


@register("b16_infer_numeric", with_sql(PROJECT_SQL) + """
SELECT * FROM (VALUES ('project_id','numeric'),('acct_balance','numeric'),('order_year','numeric'),
  ('priority','categorical'),('segment','categorical'),('status','categorical'),('year_text','numeric'),
  ('part_types','categorical')) t("column", likely)""")
def b16_infer_numeric(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "acct_balance", "order_year", "priority", "segment",
                                             "status", F.col("order_year").cast("string").alias("year_text"),
                                             "part_types")
    return S.infer_numeric(df)


@register("b17_repair_types", with_sql(PROJECT_SQL) + """
SELECT project_id, NULLIF(CAST(coalesce(priority, 'nan') AS VARCHAR), 'nan') AS priority,
       coalesce(CAST(CASE WHEN project_id % 3 = 0 THEN NULL ELSE project_id % 2 END AS BOOLEAN), false) AS odd_flag
FROM proj""")
def b17_repair_types(spark, sf_dir):
    df = project_frame(spark, sf_dir).select(
        "project_id", F.coalesce(F.col("priority"), F.lit("nan")).alias("priority"),
        F.when(F.col("project_id") % 3 == 0, F.lit(None)).otherwise(F.col("project_id") % 2).alias("odd_flag"))
    return S.repair_types(df, text_cols=["priority"], bool_cols=["odd_flag"])


@register("b18_force_numeric", with_sql(PROJECT_SQL) + """
SELECT project_id,
       coalesce(acct_balance, 0.0) AS acct_balance,
       coalesce(TRY_CAST(status AS DOUBLE), 0.0) AS status,
       CASE WHEN project_id % 5 = 0 THEN 0.0 ELSE effort END AS effort_inf
FROM proj""")
def b18_force_numeric(spark, sf_dir):
    df = project_frame(spark, sf_dir).select(
        "project_id", "acct_balance", "status",
        F.when(F.col("project_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("effort")).alias("effort_inf"))
    return S.force_numeric(df, keep=["project_id"])


def _int_advice_sql(c: str) -> str:
    return (f"CASE WHEN min({c}) >= 0 THEN CASE WHEN max({c}) < 255 THEN 'uint8' WHEN max({c}) < 65535 THEN 'uint16' "
            f"WHEN max({c}) < 4294967295 THEN 'uint32' ELSE 'int64' END "
            f"ELSE CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'int8' "
            f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'int16' "
            f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int32' ELSE 'int64' END END")


@register("b19_type_advice", f"""
WITH li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_suppkey, -l_linenumber AS neg_line
            FROM lineitem),
a AS (SELECT {_int_advice_sql('l_orderkey')} AS k, {_int_advice_sql('l_linenumber')} AS ln,
             {_int_advice_sql('l_suppkey')} AS sk, {_int_advice_sql('neg_line')} AS nl,
             CASE WHEN count(DISTINCT l_returnflag) / count(*) < 0.5 THEN 'category' ELSE 'object' END AS rf
      FROM li)
SELECT 'l_orderkey' AS "column", 'integer' AS kind, k AS advice FROM a
UNION ALL SELECT 'l_linenumber', 'integer', ln FROM a
UNION ALL SELECT 'l_quantity', 'float', 'float32' FROM a
UNION ALL SELECT 'l_returnflag', 'text', rf FROM a
UNION ALL SELECT 'l_suppkey', 'integer', sk FROM a
UNION ALL SELECT 'neg_line', 'integer', nl FROM a""")
def b19_type_advice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
                                                  "l_suppkey", (-F.col("l_linenumber")).alias("neg_line"))
    return S.type_advice(li)
