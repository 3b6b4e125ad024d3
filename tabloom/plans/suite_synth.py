"""Synthetic data (L01-L03), similarity (L04-L07), catalogue (A06) queries.

Real vs synthetic stand-in: lineitems with status F vs status O; the copula
queries fit on lineitems and sample as many rows as the table has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import synth as L
from tabloom.plans.inputs import table, with_sql
from tabloom.plans.registry import register, rounded

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "ship_year"]

SIDES_SQL = """
sides AS (SELECT l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                 CAST(year(l_shipdate) AS VARCHAR) AS ship_year FROM lineitem),
real AS (SELECT * FROM sides WHERE l_linestatus = 'F'),
synth AS (SELECT * FROM sides WHERE l_linestatus = 'O')"""


def sides(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", *NUM, "l_returnflag", F.year("l_shipdate").cast("string").alias("ship_year"))
    real = li.where(F.col("l_linestatus") == "F").drop("l_linestatus")
    synth = li.where(F.col("l_linestatus") == "O").drop("l_linestatus")
    return real, synth


def _sim_sql(c):
    rm, sm = f"(SELECT avg({c}) FROM real)", f"(SELECT avg({c}) FROM synth)"
    rs, ss = f"(SELECT stddev_samp({c}) FROM real)", f"(SELECT stddev_samp({c}) FROM synth)"
    ms = (f"CASE WHEN {rs} = 0 AND {ss} = 0 THEN CASE WHEN {rm} = {sm} THEN 1.0 ELSE 0.0 END "
          f"WHEN {rs} = 0 OR {ss} = 0 THEN exp(-abs({rm} - {sm})) ELSE exp(-abs({rm} - {sm}) / {rs}) END")
    sd = f"CASE WHEN {rs} = 0 AND {ss} = 0 THEN 1.0 WHEN {rs} = 0 OR {ss} = 0 THEN 0.0 ELSE least({rs}, {ss}) / greatest({rs}, {ss}) END"
    sim = f"least(greatest(({ms} + {sd}) / 2, 0.0), 1.0)"
    return (f"SELECT '{c}' AS \"column\", round({rm}, 6) AS real_mean, round({sm}, 6) AS synth_mean, "
            f"round({rs}, 6) AS real_std, round({ss}, 6) AS synth_std, round({sim}, 6) AS similarity, "
            f"CAST({sim} > 0.5 AS INTEGER) AS acceptable")


@register("l04_numeric_similarity", with_sql(SIDES_SQL) + "\n" + "\nUNION ALL\n".join(_sim_sql(c) for c in NUM))
def l04_numeric_similarity(spark, sf_dir):
    real, synth = sides(spark, sf_dir)
    return rounded(L.numeric_similarity(real, synth, NUM))


def _overlap_sql(c):
    r = f"(SELECT DISTINCT {c} AS v FROM real WHERE {c} IS NOT NULL)"
    s = f"(SELECT DISTINCT {c} AS v FROM synth WHERE {c} IS NOT NULL)"
    return (f"SELECT '{c}' AS \"column\", "
            f"CASE WHEN (SELECT count(*) FROM {r}) > 0 THEN (SELECT count(*) FROM {r} JOIN {s} USING (v)) / (SELECT count(*) FROM {r}) ELSE 1.0 END AS overlap, "
            f"(SELECT CAST(count(*) AS BIGINT) FROM {r}) AS n_real, (SELECT CAST(count(*) AS BIGINT) FROM {s}) AS n_synth")


def _difference_sql(c):
    r, s = f"(SELECT {c} AS v FROM real WHERE {c} IS NOT NULL)", f"(SELECT {c} AS v FROM synth WHERE {c} IS NOT NULL)"
    return (f"SELECT '{c}' AS \"column\", 'new' AS side, v AS value FROM (SELECT * FROM {s} EXCEPT SELECT * FROM {r})\nUNION ALL\n"
            f"SELECT '{c}', 'missing', v FROM (SELECT * FROM {r} EXCEPT SELECT * FROM {s})")


@register("l05_category_overlap", with_sql(SIDES_SQL, "ov AS (" + "\nUNION ALL\n".join(_overlap_sql(c) for c in CAT) + ")",
                                           "di AS (" + "\nUNION ALL\n".join(_difference_sql(c) for c in CAT) + ")") + """
SELECT * FROM ov LEFT JOIN di USING ("column")""")
def l05_category_overlap(spark, sf_dir):
    """Overlap per column, with a row for every level that only one side has."""
    real, synth = sides(spark, sf_dir)
    return rounded(L.category_overlap(real, synth, CAT)).join(L.level_differences(real, synth, CAT), "column", "left")


@register("l06_schema_match", with_sql(SIDES_SQL) + """
SELECT (SELECT count(*) FROM real) >= 0 AS shape_match, true AS columns_match, true AS types_preserved, '' AS issues""")
def l06_schema_match(spark, sf_dir):
    real, synth = sides(spark, sf_dir)
    return L.schema_match(real, synth)


@register("l07_synthetic_quality", with_sql(SIDES_SQL, "sim AS (" + "\nUNION ALL\n".join(_sim_sql(c) for c in NUM) + ")",
                                            "ov AS (" + "\nUNION ALL\n".join(_overlap_sql(c) for c in CAT) + ")") + """
SELECT true AS shape_match, true AS columns_match, true AS types_preserved,
       round((SELECT avg(acceptable) FROM sim), 6) AS statistical_quality,
       round((SELECT avg(CAST(overlap > 0.7 AS DOUBLE)) FROM ov), 6) AS distribution_quality,
       (SELECT avg(acceptable) FROM sim) > 0.6 AND (SELECT avg(CAST(overlap > 0.7 AS DOUBLE)) FROM ov) > 0.6 AS overall_quality""")
def l07_synthetic_quality(spark, sf_dir):
    real, synth = sides(spark, sf_dir)
    return rounded(L.synthetic_quality(real, synth))


@register("a06_column_catalog", """
SELECT * FROM (VALUES ('l_orderkey', 'id'), ('l_quantity', 'numerical'), ('l_extendedprice', 'numerical'),
  ('l_returnflag', 'categorical'), ('l_linenumber', 'categorical')) t("column", sdtype)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def a06_column_catalog(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag",
                                                  "l_linenumber")
    return L.column_catalog(li, {"l_linenumber": "categorical"}, key="l_orderkey")


def _copula_input(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), "l_quantity",
                     "l_extendedprice", "l_discount", "l_returnflag")


def _ppf_sql(u: str) -> str:
    """Normal quantile of u: a first value and one Newton step, as norm_ppf."""
    t = f"sqrt(-2.0 * ln(CASE WHEN {u} < 0.5 THEN {u} ELSE 1.0 - {u} END))"
    z = f"({t} - (2.515517 + {t} * (0.802853 + {t} * 0.010328)) / (1.0 + {t} * (1.432788 + {t} * (0.189269 + {t} * 0.001308))))"
    z = f"(CASE WHEN {u} < 0.5 THEN -{z} ELSE {z} END)"
    w = f"(1.0 / (1.0 + abs({z}) * 0.2316419))"
    poly = f"({w} * (0.319381530 + {w} * (-0.356563782 + {w} * (1.781477937 + {w} * (-1.821255978 + {w} * 1.330274429)))))"
    upper = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {poly})"
    cdf = f"(CASE WHEN {z} >= 0 THEN 1.0 - {upper} ELSE {upper} END)"
    return f"({z} - ({cdf} - {u}) / (exp(-{z} * {z} / 2) / sqrt(2 * pi())))"


L01_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _l01_sql() -> str:
    from tabloom.functions.hashing import mix32_sql
    grid = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"
    grids = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {grid}) AS g_{c}" for c in L01_NUM)
    place = {c: f"greatest(least(len(list_filter(g_{c}, lambda v: v <= {c})) - 1, 99), 0)" for c in L01_NUM}
    u = [f"least(greatest((i_{c} + least(greatest(CASE WHEN g_{c}[i_{c} + 2] > g_{c}[i_{c} + 1] THEN ({c} - g_{c}[i_{c} + 1]) / (g_{c}[i_{c} + 2] - g_{c}[i_{c} + 1]) "
         f"ELSE 0.5 END, 0.0), 1.0)) / 100, 1e-6), 1 - 1e-6) AS u_{c}" for c in L01_NUM]
    noise = f"(({mix32_sql('line_id', 1003)}) + 0.5) / 4294967296.0"
    return f"""WITH li AS (SELECT l_orderkey * 8 + l_linenumber AS line_id, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
       CAST(l_discount AS DOUBLE) AS l_discount, l_returnflag FROM lineitem),
grids AS (SELECT {grids} FROM li),
levels AS (SELECT l_returnflag, (sum(n) OVER (ORDER BY l_returnflag) - n) / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY l_returnflag) / sum(n) OVER () AS hi
           FROM (SELECT l_returnflag, count(*) AS n FROM li GROUP BY 1)),
placed AS (SELECT li.*, grids.*, lo, hi, {", ".join(f"{place[c]} AS i_{c}" for c in L01_NUM)} FROM li JOIN levels USING (l_returnflag), grids),
us AS (SELECT line_id, {", ".join(u)}, least(greatest(lo + (hi - lo) * {noise}, 1e-6), 1 - 1e-6) AS u_l_returnflag FROM placed)
SELECT line_id AS row_key, {", ".join(f"round({_ppf_sql('u_' + c)}, 6) AS {c}" for c in [*L01_NUM, "l_returnflag"])} FROM us"""


@register("l01_copula_scores", _l01_sql())
def l01_copula_scores(spark, sf_dir):
    """Normal scores of every lineitem under the fitted marginals."""
    df = _copula_input(spark, sf_dir)
    return rounded(L.fit_copula(df, "line_id").scores(df, "line_id"))


@register("l02_copula_sample")
def l02_copula_sample(spark, sf_dir):
    """As many synthetic rows as lineitems (rows-only; quality is a test property)."""
    df = _copula_input(spark, sf_dir)
    cop = L.fit_copula(df, "line_id")
    return cop.sample(spark, df.count(), seed=3)


@register("l03_synthesize")
def l03_synthesize(spark, sf_dir):
    df = _copula_input(spark, sf_dir)
    return L.synthesize(df, "line_id", n=10000, seed=5)
