"""Missing values (D01-D11), profiling (E01-E19) and correlation (F01-F06) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import correlation as C
from tabloom.operators import missing as M
from tabloom.operators import profile as P
from tabloom.plans.inputs import PROJECT_SQL, project_frame, table, with_sql
from tabloom.plans.registry import register, round_cols, rounded
from tabloom.session import materialize

PCOLS = ["project_id", "effort", "acct_balance", "sparse_metric", "order_year", "priority", "segment", "status",
         "region", "nation", "part_types", "part_brands"]
NUMS = ["project_id", "effort", "acct_balance", "sparse_metric", "order_year"]
TXT = ["priority", "segment", "status", "region", "nation", "part_types", "part_brands"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# --- D ----------------------------------------------------------------------
@register("d01_missing_profile", with_sql(PROJECT_SQL) + "\n" + _union([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"round((count(*) - count({c})) / count(*), 6) AS missing_frac FROM proj" for c in PCOLS]))
def d01_missing_profile(spark, sf_dir):
    return rounded(M.missing_profile(project_frame(spark, sf_dir)))


@register("d01_missing_summary", with_sql(PROJECT_SQL, "p AS (" + _union([
    f"SELECT (count(*) - count({c})) AS n, (count(*) - count({c})) / count(*) AS f FROM proj" for c in PCOLS]) + ")") + """
SELECT CAST(count_if(f > 0.5) AS BIGINT) AS above_half, CAST(count_if(f > 0.7) AS BIGINT) AS above_threshold,
       CAST(count_if(n > 0) AS BIGINT) AS with_missing FROM p""")
def d01_missing_summary(spark, sf_dir):
    return M.missing_summary(M.missing_profile(project_frame(spark, sf_dir)), 0.7)


@register("d02_missing_handler", with_sql(PROJECT_SQL) + f"""
SELECT project_id, effort, coalesce(acct_balance, (SELECT median(acct_balance) FROM proj)) AS acct_balance,
       order_year, {", ".join(f"coalesce({c}, 'missing') AS {c}" for c in TXT)}
FROM proj""", headline=True)
def d02_missing_handler(spark, sf_dir):
    # fit (two passes) + transform read the derived input three times: cut lineage once
    df = materialize(project_frame(spark, sf_dir))
    return M.MissingHandler(threshold=0.7).fit(df).transform(df)


@register("d02_missing_handler_keep", with_sql(PROJECT_SQL) + """
SELECT project_id, effort, coalesce(acct_balance, (SELECT median(acct_balance) FROM proj)) AS acct_balance,
       coalesce(sparse_metric, (SELECT median(sparse_metric) FROM proj)) AS sparse_metric, order_year
FROM proj""")
def d02_missing_handler_keep(spark, sf_dir):
    df = project_frame(spark, sf_dir).select(*NUMS)
    return M.MissingHandler(threshold=0.7, keep=["sparse_metric"]).fit(df).transform(df)


@register("d05_simple_imputer", with_sql(PROJECT_SQL, """
modes AS (SELECT priority AS v, count(*) AS n FROM proj WHERE priority IS NOT NULL GROUP BY 1)""") + """
SELECT project_id, coalesce(acct_balance, (SELECT avg(acct_balance) FROM proj)) AS acct_balance,
       coalesce(priority, (SELECT v FROM modes ORDER BY n DESC, v LIMIT 1)) AS priority,
       coalesce(part_types, (SELECT v FROM (SELECT part_types AS v, count(*) AS n FROM proj
                 WHERE part_types IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS part_types
FROM proj""")
def d05_simple_imputer(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "acct_balance", "priority", "part_types")
    return rounded(M.SimpleImputer().fit(df).transform(df), 6)


INF_SQL = """
numx AS (SELECT project_id, acct_balance,
  CASE WHEN project_id % 5 = 0 THEN 'inf'::DOUBLE WHEN project_id % 5 = 1 THEN '-inf'::DOUBLE ELSE effort END AS effort_inf,
  CAST(NULL AS DOUBLE) AS all_null FROM proj)"""


def _numx(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    k = F.col("project_id")
    return df.select("project_id", "acct_balance",
                     F.when(k % 5 == 0, F.lit(float("inf"))).when(k % 5 == 1, F.lit(float("-inf")))
                     .otherwise(F.col("effort")).alias("effort_inf"),
                     F.lit(None).cast("double").alias("all_null"))


def _fin(c):
    return f"CASE WHEN isinf({c}) THEN NULL ELSE {c} END"


@register("d06_clean_numeric_mean", with_sql(PROJECT_SQL, INF_SQL) + f"""
SELECT round(coalesce(CAST(project_id AS DOUBLE), (SELECT avg(project_id) FROM numx)), 4) AS project_id,
       round(coalesce(acct_balance, (SELECT avg(acct_balance) FROM numx)), 4) AS acct_balance,
       round(coalesce({_fin('effort_inf')}, (SELECT avg({_fin('effort_inf')}) FROM numx)), 4) AS effort_inf
FROM numx""")
def d06_clean_numeric_mean(spark, sf_dir):
    return rounded(M.clean_numeric(_numx(spark, sf_dir), "mean"), 4)


@register("d07_clean_numeric_median", with_sql(PROJECT_SQL, INF_SQL) + f"""
SELECT project_id,
       coalesce(acct_balance, (SELECT median(acct_balance) FROM numx)) AS acct_balance,
       effort_inf
FROM numx""")
def d07_clean_numeric_median(spark, sf_dir):
    return M.clean_numeric(_numx(spark, sf_dir), "median", exclude=["project_id", "effort_inf"])


@register("d08_zero_fill", with_sql(PROJECT_SQL) + """
SELECT project_id, coalesce(acct_balance, 0.0) AS acct_balance, coalesce(sparse_metric, 0.0) AS sparse_metric,
       priority FROM proj""")
def d08_zero_fill(spark, sf_dir):
    return M.zero_fill(project_frame(spark, sf_dir).select("project_id", "acct_balance", "sparse_metric", "priority"))


@register("d09_remaining_missing", with_sql(PROJECT_SQL) + "\nSELECT * FROM (" + _union([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"round((count(*) - count({c})) / count(*), 6) AS missing_frac FROM proj" for c in PCOLS]) + ") WHERE n_missing > 0")
def d09_remaining_missing(spark, sf_dir):
    return rounded(M.missing_profile(project_frame(spark, sf_dir)).where(F.col("n_missing") > 0))


@register("d10_missing_patterns", with_sql(PROJECT_SQL) + f"""
SELECT {" || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PCOLS)} AS pattern,
       CAST(count(*) AS BIGINT) AS n
FROM proj GROUP BY 1""")
def d10_missing_patterns(spark, sf_dir):
    return M.missing_patterns(project_frame(spark, sf_dir))


@register("d11_drop_incomplete", with_sql(PROJECT_SQL, INF_SQL) + """
SELECT * FROM numx WHERE acct_balance IS NOT NULL AND effort_inf IS NOT NULL AND NOT isinf(effort_inf)
  AND NOT isnan(effort_inf) AND NOT isnan(acct_balance)""")
def d11_drop_incomplete(spark, sf_dir):
    return M.drop_incomplete(_numx(spark, sf_dir), ["acct_balance", "effort_inf"])


# --- E ----------------------------------------------------------------------
SPARK_TYPES = {"project_id": "bigint", "effort": "double", "acct_balance": "double", "sparse_metric": "double",
               "order_year": "int"}


def _samples_sql(c: str) -> str:
    return (f"(SELECT array_to_string(list_transform(list_sort(list(v)), lambda x: CAST(x AS VARCHAR)), ', ') FROM "
            f"(SELECT DISTINCT {c} AS v FROM proj WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))")


@register("e01_data_summary", with_sql(PROJECT_SQL) + "\n" + _union([
    f"SELECT '{c}' AS \"column\", '{SPARK_TYPES.get(c, 'string')}' AS data_type, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS n_null, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {_samples_sql(c)} AS samples FROM proj"
    for c in ["project_id", "order_year", *TXT]]))
def e01_data_summary(spark, sf_dir):
    # five passes over a derived input (nulls, two distinct families, samples): cut lineage once
    df = materialize(project_frame(spark, sf_dir).select("project_id", "order_year", *TXT))
    return rounded(P.data_summary(df))


@register("e02_describe_numeric", with_sql(PROJECT_SQL) + "\n" + _union([
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 8) AS q25, "
    f"round(median({c}), 8) AS median, round(quantile_cont({c}, 0.75), 8) AS q75, max({c}) AS max FROM proj"
    for c in NUMS]), headline=True)
def e02_describe_numeric(spark, sf_dir):
    return round_cols(P.describe_numeric(project_frame(spark, sf_dir)),
                      {"mean": 4, "std": 4, "q25": 8, "median": 8, "q75": 8})


@register("e04_duplicate_rows", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(count(*) AS BIGINT) AS n_unique_rows FROM g""")
def e04_duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


E05_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_partkey"]


@register("e05_distinct_counts", "\n" + _union([
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem" for c in E05_COLS]))
def e05_distinct_counts(spark, sf_dir):
    return P.distinct_counts(table(spark, sf_dir, "lineitem"), E05_COLS)


@register("e06_value_counts", """
SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders GROUP BY 1""")
def e06_value_counts(spark, sf_dir):
    return rounded(P.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority"))


@register("e07_top_with_other", with_sql(PROJECT_SQL, """
c AS (SELECT nation AS value, count(*) AS n FROM proj GROUP BY 1),
top AS (SELECT value, n FROM c ORDER BY n DESC, value LIMIT 9),
rows_ AS (SELECT value, n FROM top UNION ALL SELECT 'Other', (SELECT sum(n) FROM c) - (SELECT sum(n) FROM top))""") + """
SELECT value, CAST(n AS BIGINT) AS n, round(n * 100.0 / (SELECT sum(n) FROM c), 6) AS pct FROM rows_""")
def e07_top_with_other(spark, sf_dir):
    return rounded(P.top_with_other(project_frame(spark, sf_dir), "nation", 10))


@register("e08_category_candidates", with_sql(PROJECT_SQL) + "\nSELECT * FROM (" + _union([
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM proj" for c in TXT])
    + ") WHERE n_distinct < greatest(30, 0.05 * (SELECT count(*) FROM proj))")
def e08_category_candidates(spark, sf_dir):
    return P.category_candidates(project_frame(spark, sf_dir))


@register("e09_histogram", with_sql(PROJECT_SQL, """
st AS (SELECT min(effort) AS lo, max(effort) AS hi FROM proj),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((effort - lo) / (hi - lo) * 10), 9) END AS INTEGER) AS bin,
             count(*) AS n FROM proj, st WHERE effort IS NOT NULL GROUP BY 1)""") + """
SELECT g.bin, round(lo + (hi - lo) * g.bin / 10, 4) AS lo, round(lo + (hi - lo) * (g.bin + 1) / 10, 4) AS hi,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) g CROSS JOIN st LEFT JOIN b ON g.bin = b.bin""")
def e09_histogram(spark, sf_dir):
    return rounded(P.histogram(project_frame(spark, sf_dir), "effort", 10), 4)


@register("e09_column_stats", with_sql(PROJECT_SQL) + """
SELECT round(avg(effort), 4) AS mean, round(median(effort), 4) AS median, round(stddev_samp(effort), 4) AS std,
       round(min(effort), 4) AS min, round(max(effort), 4) AS max FROM proj""")
def e09_column_stats(spark, sf_dir):
    return rounded(P.column_stats(project_frame(spark, sf_dir), "effort"), 4)


@register("e10_box_stats", with_sql(PROJECT_SQL) + """
SELECT segment AS category, CAST(count(effort) AS BIGINT) AS n, round(min(effort), 4) AS min,
       round(quantile_cont(effort, 0.25), 4) AS q25, round(median(effort), 4) AS median,
       round(quantile_cont(effort, 0.75), 4) AS q75, round(max(effort), 4) AS max
FROM proj GROUP BY segment""")
def e10_box_stats(spark, sf_dir):
    return rounded(P.box_stats(project_frame(spark, sf_dir), "segment", "effort"), 4)


@register("e11_box_candidates", with_sql(PROJECT_SQL) + """
SELECT 'numeric' AS role, 'effort' AS "column"
UNION ALL SELECT 'categorical', c FROM (VALUES ('priority'), ('segment'), ('status'), ('region')) t(c)""")
def e11_box_candidates(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    num, cats = P.box_candidates(df)
    return spark.createDataFrame([("numeric", num)] + [("categorical", c) for c in cats], "role string, column string")


def _kind_sql(c: str, kind: str) -> str:
    """E12 rules as SQL for one column of ``kx``; ``kind`` is its storage kind."""
    from tabloom.operators.profile import BOOLEAN_WORDS
    words = ", ".join(f"'{w}'" for w in BOOLEAN_WORDS)
    s = f"lower(CAST({c} AS VARCHAR))"
    boolean = (f"(count({c}) > 0 AND coalesce(count_if({c} IS NOT NULL AND {s} NOT IN ({words})), 0) = 0 "
               f"AND count(DISTINCT {s}) <= 4)")
    small = f"(count(DISTINCT {c}) <= 5 OR (count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) / count({c}) < 0.5))"
    if kind == "text":
        body = "'categorical'"
    elif kind == "int":
        body = f"CASE WHEN {boolean} OR {small} THEN 'categorical' ELSE 'discrete' END"
    else:
        il = f"avg(CAST(abs({c} - round({c})) < 1e-10 AS DOUBLE))"
        body = (f"CASE WHEN {boolean} THEN 'categorical' WHEN {il} > 0.8 THEN "
                f"CASE WHEN {small} THEN 'categorical' ELSE 'discrete' END ELSE 'continuous' END")
    return f"SELECT '{c}' AS \"column\", {body} AS kind" + ("" if kind == "text" else " FROM kx")


KIND_COLS = [("l_orderkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"),
             ("l_discount", "float"), ("l_returnflag", "text"), ("flag", "text"), ("bucket", "int")]


@register("e12_detect_kinds", """WITH kx AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_returnflag, CASE WHEN l_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag,
  CAST(l_orderkey % 3 AS INTEGER) AS bucket FROM lineitem)
""" + _union([_kind_sql(c, k) for c, k in KIND_COLS]))
def e12_detect_kinds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        F.when(F.col("l_orderkey") % 2 == 0, "yes").otherwise("no").alias("flag"),
        (F.col("l_orderkey") % 3).cast("int").alias("bucket"))
    return P.detect_kinds(li)


@register("e15_quality_issues", """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, 'x' AS const_col, CAST(NULL AS VARCHAR) AS empty_col FROM customer)
SELECT 'all_null' AS issue, 'empty_col' AS "column"
UNION ALL SELECT 'single_value', 'const_col' UNION ALL SELECT 'single_value', 'empty_col'
UNION ALL SELECT 'high_cardinality', 'c_name'""")
def e15_quality_issues(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("x").alias("const_col"),
                                               F.lit(None).cast("string").alias("empty_col"))
    return P.quality_issues(c, categorical=["c_name", "c_mktsegment", "const_col", "empty_col"])


@register("e16_infinite_count", with_sql(PROJECT_SQL, INF_SQL) + """
SELECT 'acct_balance' AS "column", CAST(coalesce(count_if(isinf(acct_balance)), 0) AS BIGINT) AS n_inf FROM numx
UNION ALL SELECT 'effort_inf', CAST(coalesce(count_if(isinf(effort_inf)), 0) AS BIGINT) FROM numx
UNION ALL SELECT 'all_null', CAST(coalesce(count_if(isinf(all_null)), 0) AS BIGINT) FROM numx""")
def e16_infinite_count(spark, sf_dir):
    return P.infinite_count(_numx(spark, sf_dir))


@register("e18_validate_features_table", with_sql(PROJECT_SQL) + """
SELECT true AS valid, '' AS warnings, '' AS errors, CAST(count(*) AS BIGINT) AS rows, 3 AS columns,
       CAST(0 AS BIGINT) AS missing_total, CAST(0 AS BIGINT) AS infinite_total, 3 AS numeric_columns,
       0 AS non_numeric_columns
FROM proj""")
def e18_validate_features_table(spark, sf_dir):
    from tabloom.operators.schema import force_numeric
    df = force_numeric(project_frame(spark, sf_dir).select("project_id", "acct_balance", "effort"))
    return P.validate_features_table(df)


@register("e19_target_summary", """
SELECT 'n_distinct' AS metric, CAST(count(DISTINCT l_quantity) AS BIGINT) AS value FROM lineitem
UNION ALL SELECT 'n_missing', CAST(count(*) - count(l_quantity) AS BIGINT) FROM lineitem
UNION ALL SELECT * FROM (SELECT 'count:' || CAST(l_quantity AS VARCHAR), CAST(count(*) AS BIGINT) FROM lineitem
                         GROUP BY l_quantity ORDER BY count(*) DESC, CAST(l_quantity AS VARCHAR) LIMIT 10)""")
def e19_target_summary(spark, sf_dir):
    return P.target_summary(table(spark, sf_dir, "lineitem"), "l_quantity", 10)


# --- F ----------------------------------------------------------------------
LCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue"]
LINE_SQL = "li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LCOLS[:4], (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def _pairs_sql(cols, both=True):
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM li")
            if both:
                out.append(f"SELECT '{b}' AS a, '{a}' AS b, round(corr({a}, {b}), 6) AS r FROM li")
    if both:
        out += [f"SELECT '{a}' AS a, '{a}' AS b, 1.0 AS r" for a in cols]
    return _union(out)


@register("f01_correlations", with_sql(LINE_SQL) + "\n" + _pairs_sql(LCOLS), headline=True)
def f01_correlations(spark, sf_dir):
    return rounded(C.correlations(_lines(spark, sf_dir), LCOLS))


@register("f02_top_correlations", with_sql(LINE_SQL) + "\nSELECT * FROM (" + _pairs_sql(LCOLS, False)
          + ") WHERE abs(r) < 1 ORDER BY abs(r) DESC, a, b LIMIT 15")
def f02_top_correlations(spark, sf_dir):
    return rounded(C.top_correlations(_lines(spark, sf_dir), LCOLS, 15))


@register("f03_high_correlations", with_sql(LINE_SQL) + "\nSELECT * FROM (" + _pairs_sql(LCOLS, False)
          + ") WHERE abs(r) > 0.7")
def f03_high_correlations(spark, sf_dir):
    return rounded(C.high_correlations(_lines(spark, sf_dir), LCOLS, 0.7))


@register("f04_removal_candidates", with_sql(LINE_SQL) + "\nSELECT \"column\", CAST(count(*) AS BIGINT) AS n_pairs FROM ("
          "SELECT unnest([a, b]) AS \"column\" FROM (" + _pairs_sql(LCOLS, False) + ") WHERE abs(r) > 0.7) GROUP BY 1")
def f04_removal_candidates(spark, sf_dir):
    return C.removal_candidates(C.high_correlations(_lines(spark, sf_dir), LCOLS, 0.7))


@register("f05_vif", with_sql(LINE_SQL, """
g AS (SELECT sum(l_quantity * l_quantity) AS xx, sum(l_tax * l_tax) AS yy, sum(l_quantity * l_tax) AS xy FROM li)""") + """
SELECT 'l_quantity' AS "column", round(1 / (1 - xy * xy / (xx * yy)), 6) AS vif, CAST(1 / (1 - xy * xy / (xx * yy)) > 10 AS INTEGER) AS high FROM g
UNION ALL SELECT 'l_tax', round(1 / (1 - xy * xy / (xx * yy)), 6), CAST(1 / (1 - xy * xy / (xx * yy)) > 10 AS INTEGER) FROM g""")
def f05_vif(spark, sf_dir):
    return rounded(C.vif(_lines(spark, sf_dir), ["l_quantity", "l_tax"]))


PRED_SQL = """
preds AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice AS label,
  2 * l_quantity + 1 AS pred_lr, 3 * l_quantity AS pred_ridge, l_extendedprice / 100 + l_tax AS pred_gbr
  FROM lineitem)"""


def pred_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("label"),
                     (2 * F.col("l_quantity") + 1).alias("pred_lr"), (3 * F.col("l_quantity")).alias("pred_ridge"),
                     (F.col("l_extendedprice") / 100 + F.col("l_tax")).alias("pred_gbr"))


@register("f06_prediction_correlations", with_sql(PRED_SQL, "li AS (SELECT * FROM preds)") + "\n"
          + _pairs_sql(["pred_lr", "pred_ridge", "pred_gbr"]))
def f06_prediction_correlations(spark, sf_dir):
    return rounded(C.correlations(pred_frame(spark, sf_dir), ["pred_lr", "pred_ridge", "pred_gbr"]))


# --- E03: full analysis as one long table ----------------------------------------
E03_NUM = ["project_id", "order_year", "acct_balance", "effort", "is_odd"]
E03_TXT = ["priority", "urgent"]
E03_FLAGS = ["is_odd", "urgent"]
E03_SQL = """
ana AS (SELECT project_id, order_year, acct_balance, effort, project_id % 2 AS is_odd, priority,
               CASE WHEN priority = '1-URGENT' THEN 'Yes' WHEN priority IS NOT NULL THEN 'no' END AS urgent FROM proj)"""


def analysis_frame(spark, sf_dir):
    """Project columns and two boolean-like ones."""
    urgent = F.when(F.col("priority") == "1-URGENT", "Yes").when(F.col("priority").isNotNull(), "no")
    return materialize(project_frame(spark, sf_dir).select(
        "project_id", "order_year", "acct_balance", "effort", (F.col("project_id") % 2).alias("is_odd"), "priority", urgent.alias("urgent")))


def _kind_sql(c: str) -> str:
    few = f"(count(DISTINCT {c}) <= 5 OR (count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) / count({c}) < 0.5))"
    if c in E03_TXT + E03_FLAGS:
        return "min('categorical')"
    whole = "true" if c in ("project_id", "order_year") else f"avg(CAST(abs({c} - round({c})) < 1e-10 AS DOUBLE)) > 0.8"
    return f"CASE WHEN NOT ({whole}) THEN 'continuous' WHEN {few} THEN 'categorical' ELSE 'discrete' END"


def analysis_sql() -> str:
    """(column, metric, value, detail) of the analysed columns."""
    none = "CAST(NULL AS VARCHAR)"
    parts = []
    for c in E03_NUM + E03_TXT:
        parts.append(f"SELECT '{c}' AS \"column\", unnest(['n_null', 'null_pct', 'n_distinct']) AS metric, "
                     f"unnest([CAST(count(*) - count({c}) AS DOUBLE), (count(*) - count({c})) * 100.0 / count(*), "
                     f"CAST(count(DISTINCT {c}) AS DOUBLE)]) AS value, {none} AS detail FROM ana")
        parts.append(f"SELECT '{c}', 'recommended_kind', CAST(NULL AS DOUBLE), {_kind_sql(c)} FROM ana")
    for c in E03_NUM:
        if c not in E03_FLAGS:
            parts.append(f"SELECT '{c}', unnest(['count', 'mean', 'std', 'min', 'q25', 'median', 'q75', 'max']), "
                         f"unnest([CAST(count({c}) AS DOUBLE), avg({c}), stddev_samp({c}), min({c}), "
                         f"quantile_cont({c}, 0.25), median({c}), quantile_cont({c}, 0.75), max({c})]), {none} FROM ana")
    for c in E03_FLAGS:
        counts = f"SELECT CAST({c} AS VARCHAR) AS v, CAST(count(*) AS DOUBLE) AS n FROM ana WHERE {c} IS NOT NULL GROUP BY 1"
        parts.append(f"SELECT '{c}', 'value_count', n, v FROM ({counts})")
        parts.append(f"SELECT '{c}', 'most_common', n, v FROM (SELECT * FROM ({counts}) ORDER BY n DESC, v LIMIT 1)")
    parts.append(f"SELECT '__table__', unnest(['rows', 'columns']), unnest([CAST(count(*) AS DOUBLE), 7.0]), {none} FROM ana")
    return _union(parts)


@register("e03_analyze", with_sql(PROJECT_SQL, E03_SQL) + "\nSELECT \"column\", metric, round(value, 4) AS value, detail FROM (" + analysis_sql() + ")")
def e03_analyze(spark, sf_dir):
    return rounded(P.analyze(analysis_frame(spark, sf_dir)), 4)


@register("b14_drop_columns", with_sql(PROJECT_SQL) + """
SELECT project_id, effort, acct_balance, order_year, segment, status, region, nation FROM proj""")
def b14_drop_columns(spark, sf_dir):
    from tabloom.operators.schema import drop_columns
    return drop_columns(project_frame(spark, sf_dir), ["sparse_metric", "priority", "part_types", "part_brands"])
