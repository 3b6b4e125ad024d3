"""Profiling and validation aggregates.

Rule for every operator here: one wide aggregate over all columns (partial
aggregation map-side, one row to the driver), then ``stack`` to long form.
Exact distinct counts never use many ``count(DISTINCT)`` at once (that plans an
``Expand`` that copies every row once per column); they unpivot to
(column, value) pairs, de-duplicate with map-side combine and count per column.
Per-column "first n values" samples use a two-level salted window so that no
single task sorts all distinct values of a huge column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DoubleType, FloatType, IntegerType, LongType, NumericType,
                               ShortType, StringType, BooleanType)

from tabloom.operators.counted import CountedValues, counted_values
from tabloom.operators.missing import is_missing
from tabloom.operators.quantiles import known, quantile_table
from tabloom.operators.schema import q

INTEGRAL = (LongType, IntegerType, ShortType, ByteType)
# Boolean-like spellings of the kind detector (E13) and the
# prepared-feature validation messages.
BOOLEAN_WORDS = ["true", "false", "1", "0", "1.0", "0.0", "yes", "no", "y", "n", "t", "f"]
MSG_EMPTY = "DataFrame is empty"
MSG_MISSING = "Found {n} missing values"
MSG_INFINITE = "Found {n} infinite values"
MSG_NON_NUMERIC = "Non-numeric columns found: {cols}"


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _family(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType
    if isinstance(t, INTEGRAL):
        return "bigint"
    if isinstance(t, NumericType):
        return "double"
    if isinstance(t, BooleanType):
        return "boolean"
    return "string"


def stack_wide(wide: DataFrame, cols: Sequence[str], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Wide one-row aggregate with columns ``{prefix}{i}`` -> long (column, names...)."""
    args = []
    for i, c in enumerate(cols):
        args.append(F.lit(c))
        args += [F.col(f"{p}{i}") for p, _ in fields]
    return wide.select(F.stack(F.lit(len(cols)), *args).alias("column", *[n for _, n in fields]))


# E05 -----------------------------------------------------------------------
def distinct_pairs_typed(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Distinct (column, value) per type family (numeric values compared as doubles)."""
    fam: dict[str, list[str]] = {}
    for c in cols:
        fam.setdefault(_family(df, c), []).append(c)
    out = {}
    for f, cs in fam.items():
        long = df.select(*[q(c).cast(f).alias(c) for c in cs]).unpivot([], cs, "column", "value")
        out[f] = long.where(F.col("value").isNotNull()).select("column", "value").distinct()
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_distinct) of non-null values. ``approx`` = HLL in one aggregate."""
    cols = list(cols or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        return stack_wide(wide, cols, [("d", "n_distinct")])
    parts = [p.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
             for p in distinct_pairs_typed(df, cols).values()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(res, "column", "left").select(
        "column", F.coalesce(F.col("n_distinct"), F.lit(0)).cast("bigint").alias("n_distinct"))


def first_n_listing(pairs: DataFrame, n: int, sep: str = ", ", name: str = "samples", salt: int = 64) -> DataFrame:
    """(column, name): the n smallest values per column of distinct (column,
    value) pairs, joined. Ranked within (column, hash bucket) first, then
    within column, so no task orders all values of a large column."""
    v = F.col("value")
    b = pairs.withColumn("_b", F.pmod(F.hash(v), F.lit(salt)))
    top1 = b.withColumn("_r", F.row_number().over(Window.partitionBy("column", "_b").orderBy(v))).where(F.col("_r") <= n)
    top = top1.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(v))).where(F.col("_r") <= n)
    return top.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(v)), lambda x: x.cast("string")), sep).alias(name))


def first_values(df: DataFrame, cols: Sequence[str], n: int = 5, salt: int = 64) -> DataFrame:
    """(column, samples): the n smallest distinct values per column joined by ', '.

    Two-level top-n: within (column, hash bucket) then within column, so one
    task never orders more than a bucket of a column's distinct values."""
    res = None
    for pairs in distinct_pairs_typed(df, cols).values():
        agg = first_n_listing(pairs, n, ", ", "samples", salt)
        res = agg if res is None else res.unionByName(agg)
    return res


# E01 -----------------------------------------------------------------------
def data_summary(df: DataFrame, n: int = 5) -> DataFrame:
    """(column, data_type, n_null, null_pct, n_distinct, samples)."""
    return _summary(df, counted_values(df), n)


def _summary(df: DataFrame, counted: CountedValues, n: int) -> DataFrame:
    rows, missing, distinct = counted.rows, counted.missing, counted.distinct
    known = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString(), missing[c], missing[c] * 100.0 / rows if rows else None, distinct[c]) for c in df.columns],
        "column string, data_type string, n_null bigint, null_pct double, n_distinct bigint")
    return known.join(counted.first_values(n), "column", "left")


# E02 -----------------------------------------------------------------------
QUARTILES = [0.25, 0.5, 0.75]


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, count, mean, std, min, q25, median, q75, max) of the known values (NaN
    is missing); std is the sample std. Quartiles are exact and interpolated, as
    pandas', at every size; ``approx`` takes a sketch instead."""
    cols = list(cols or numeric_cols(df))
    if not approx:
        return _described(df, counted_values(df, cols), cols)
    aggs = []
    for i, c in enumerate(cols):
        x = known(q(c))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.percentile_approx(x, QUARTILES, 10000).alias(f"p{i}")]
    parts = [("n", "count"), ("a", "mean"), ("s", "std"), ("lo", "min"), ("hi", "max"), ("p", "p")]
    long = stack_wide(df.agg(*aggs), cols, parts)
    quarters = [F.col("p")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))]
    return long.select("column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min", *quarters, "max")


_DESCRIBED = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]


def _described(df: DataFrame, counted: CountedValues, cols: Sequence[str]) -> DataFrame:
    rows = [(c, *[d[k] for k in _DESCRIBED]) for c, d in counted.describe(cols).items()]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, " + ", ".join(f"{k} double" for k in _DESCRIBED[1:]))


# E04 -----------------------------------------------------------------------
def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows that repeat an earlier identical row."""
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
                 F.count(F.lit(1)).cast("bigint").alias("n_unique_rows"))


# E06 -----------------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) over non-null values."""
    c = df.where(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.where(q(col).isNotNull()).agg(F.count(F.lit(1)).alias("_t"))
    return c.crossJoin(total).select("value", F.col("n").cast("bigint").alias("n"), (F.col("n") / F.col("_t")).alias("share"))


# E07 -----------------------------------------------------------------------
def top_with_other(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Top n-1 values + 'Other' (when more than n distinct), with % of the total."""
    counts = df.where(q(col).isNotNull()).groupBy(q(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    k = counts.count()
    total = counts.agg(F.sum("n").alias("_t"))
    if k > n:
        top = counts.orderBy(F.desc("n"), "value").limit(n - 1)
        other = top.agg(F.sum("n").alias("_s")).crossJoin(total).select(
            F.lit("Other").alias("value"), (F.col("_t") - F.col("_s")).alias("n"))
        rows = top.unionByName(other)
    else:
        rows = counts
    return rows.crossJoin(total).select("value", F.col("n").cast("bigint").alias("n"),
                                        (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


# E08 -----------------------------------------------------------------------
def category_candidates(df: DataFrame) -> DataFrame:
    """Text columns with distinct < max(30, 5 % of rows)."""
    cols = text_cols(df)
    rows = df.count()
    limit = max(30, 0.05 * rows)
    return distinct_counts(df, cols).where(F.col("n_distinct") < F.lit(limit))


# E09 -----------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins over [min, max], last bin closed."""
    x = q(col).cast("double")
    st = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo"))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    counted = (df.where(x.isNotNull()).crossJoin(st).groupBy(b.alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(st)
    return grid.join(counted, "bin", "left").select(
        "bin", (F.col("_lo") + width * F.col("bin") / bins).alias("lo"),
        (F.col("_lo") + width * (F.col("bin") + 1) / bins).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def column_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, sample std, min, max beside a histogram (memory-safe exact median)."""
    return describe_numeric(df, [col]).select("mean", "median", "std", "min", "max")


# E10 -----------------------------------------------------------------------
def box_stats(df: DataFrame, cat: str, num: str, approx: bool = False) -> DataFrame:
    """Five-number summary per category; quartiles are exact for groups of any
    cardinality (``approx``: a sketch)."""
    x = known(q(num))
    p = [F.percentile_approx(x, QUARTILES, 10000).alias("_p")] if approx else []
    g = df.groupBy(q(cat).alias("category")).agg(F.count(x).cast("bigint").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), *p)
    if approx:
        return g.select("category", "n", "min", F.col("_p")[0].alias("q25"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q75"), "max")
    quarters = (quantile_table(df, [num], QUARTILES, by=[cat])
                .select(q(cat).alias("_cat"), F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75")))
    return (g.join(quarters, F.col("category").eqNullSafe(F.col("_cat")), "left")
            .select("category", "n", "min", "q25", "median", "q75", "max"))


# E11 -----------------------------------------------------------------------
def box_candidates(df: DataFrame, max_levels: int = 15, n_cats: int = 4) -> tuple[str | None, list[str]]:
    nums, txt = numeric_cols(df), text_cols(df)
    var = None
    if nums:
        row = df.agg(*[F.var_samp(q(c)).alias(f"v{i}") for i, c in enumerate(nums)]).first()
        vals = [(row[f"v{i}"], c) for i, c in enumerate(nums) if row[f"v{i}"] is not None]
        var = max(vals)[1] if vals else None
    cats = [r["column"] for r in distinct_counts(df, txt).collect() if r["n_distinct"] <= max_levels]
    cats = [c for c in txt if c in cats][:n_cats]
    return var, cats


# E12 / E13 / E14 ---------------------------------------------------------------
def detect_kinds(df: DataFrame, threshold: int = 20, small: int = 5, ratio: float = 0.5) -> DataFrame:
    """(column, kind): categorical / discrete / continuous, from distinct counts,
    boolean-likeness and integer-likeness of the counted values."""
    kinds, _ = _kinds(df, counted_values(df), threshold, small, ratio)
    return df.sparkSession.createDataFrame(list(kinds.items()), "column string, kind string")


def _kinds(df: DataFrame, counted: CountedValues, threshold: int = 20, small: int = 5, ratio: float = 0.5) -> tuple[dict[str, str], set[str]]:
    """({column: kind}, boolean-like columns)."""
    traits, distinct, missing = counted.traits(BOOLEAN_WORDS), counted.distinct, counted.missing
    kinds, booleans = {}, set()
    for c in df.columns:
        t, known_rows = df.schema[c].dataType, counted.rows - missing[c]
        boolean_like, integer_share = traits[c]
        if boolean_like and known_rows:
            booleans.add(c)
        few = distinct[c] <= small or (distinct[c] <= threshold and known_rows and distinct[c] / known_rows < ratio)
        whole = isinstance(t, INTEGRAL) or isinstance(t, (DoubleType, FloatType)) and integer_share is not None and integer_share > 0.8
        if isinstance(t, (StringType, BooleanType)) or c in booleans:
            kinds[c] = "categorical"
        elif whole:
            kinds[c] = "categorical" if few else "discrete"
        else:
            kinds[c] = "continuous"
    return kinds, booleans


# E15 -----------------------------------------------------------------------
def quality_issues(df: DataFrame, categorical: Sequence[str] | None = None, high_ratio: float = 0.8) -> DataFrame:
    """(issue, column): all_null, single_value, high_cardinality."""
    cols = df.columns
    categorical = text_cols(df) if categorical is None else list(categorical)
    rows = df.count()
    if rows == 0:
        raise ValueError("Input data is empty")
    dc = distinct_counts(df, cols)
    nn = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    all_null = [(("all_null"), c) for i, c in enumerate(cols) if nn[f"n{i}"] == 0]
    d = {r["column"]: r["n_distinct"] for r in dc.collect()}
    single = [("single_value", c) for c in cols if d.get(c, 0) <= 1]
    high = [("high_cardinality", c) for c in categorical if d.get(c, 0) > rows * high_ratio]
    return df.sparkSession.createDataFrame(all_null + single + high, "issue string, column string")


# E16 -----------------------------------------------------------------------
def infinite_count(df: DataFrame) -> DataFrame:
    cols = [c for c in numeric_cols(df) if isinstance(df.schema[c].dataType, (DoubleType, FloatType))]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_inf bigint")
    wide = df.agg(*[F.count_if(F.abs(q(c)) == float("inf")).alias(f"i{i}") for i, c in enumerate(cols)])
    return stack_wide(wide, cols, [("i", "n_inf")]).select("column", F.col("n_inf").cast("bigint").alias("n_inf"))


# E17 / E18 -------------------------------------------------------------------
def validate_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: rows, columns, missing total, infinite total, kind counts, target count/mean."""
    cols = df.columns
    nums = numeric_cols(df)
    floats = [c for c in nums if isinstance(df.schema[c].dataType, (DoubleType, FloatType))]
    miss = sum([F.count_if(is_missing(df, c)) for c in cols], F.lit(0)) if cols else F.lit(0)
    inf = sum([F.count_if(F.abs(q(c)) == float("inf")) for c in floats], F.lit(0)) if floats else F.lit(0)
    has_t = bool(target and target in cols)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.lit(len(cols)).cast("int").alias("columns"),
        miss.cast("bigint").alias("missing_total"),
        inf.cast("bigint").alias("infinite_total"),
        F.lit(len(nums)).cast("int").alias("numeric_columns"),
        F.lit(len(text_cols(df))).cast("int").alias("categorical_columns"),
        (F.count(q(target)) if has_t else F.lit(None)).cast("bigint").alias("target_count"),
        (F.avg(q(target)) if has_t else F.lit(None)).cast("double").alias("target_mean"))


def _msg(template: str, n: Column) -> Column:
    head, tail = template.split("{n}")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def validate_features_table(df: DataFrame) -> DataFrame:
    """Valid flag, warnings, errors and stats for a prepared feature frame."""
    v = validate_table(df)
    non_numeric = [c for c in df.columns if c not in numeric_cols(df)]
    warn = F.filter(F.array(
        F.when(F.col("missing_total") > 0, _msg(MSG_MISSING, F.col("missing_total"))),
        F.lit(MSG_NON_NUMERIC.format(cols=non_numeric)) if non_numeric else F.lit(None).cast("string")),
        lambda x: x.isNotNull())
    err = F.filter(F.array(
        F.when(F.col("rows") == 0, F.lit(MSG_EMPTY)),
        F.when(F.col("infinite_total") > 0, _msg(MSG_INFINITE, F.col("infinite_total")))),
        lambda x: x.isNotNull())
    return v.select(
        (F.size(err) == 0).alias("valid"), F.array_join(warn, " | ").alias("warnings"),
        F.array_join(err, " | ").alias("errors"), "rows", "columns", "missing_total", "infinite_total",
        "numeric_columns", F.lit(len(non_numeric)).cast("int").alias("non_numeric_columns"))


# E19 -----------------------------------------------------------------------
def target_summary(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """(metric, value): distinct, missing, and the top counts of the target."""
    x = q(target)
    s = df.agg(F.count_distinct(x).alias("n_distinct"), F.count_if(x.isNull()).alias("n_missing"))
    tops = (df.where(x.isNotNull()).groupBy(x.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(top))
    head = s.select(F.stack(F.lit(2), F.lit("n_distinct"), F.col("n_distinct").cast("bigint"),
                            F.lit("n_missing"), F.col("n_missing").cast("bigint")).alias("metric", "value"))
    return head.unionByName(tops.select(F.concat(F.lit("count:"), F.col("value")).alias("metric"),
                                        F.col("n").cast("bigint").alias("value")))


# E20 / E03 -------------------------------------------------------------------
def profile_table(df: DataFrame, n: int = 5) -> DataFrame:
    """One row per column: type, nulls, distinct count, samples and, for
    numeric columns, the describe statistics (E01 joined with E02)."""
    counted = counted_values(df)
    return _summary(df, counted, n).join(_described(df, counted, numeric_cols(df)), "column", "left")


def profile(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """The parts of a report as tables of their own; one scan feeds all but the
    correlations and the target."""
    from tabloom.operators.correlation import correlations
    from tabloom.operators.missing import missing_profile
    counted = counted_values(df)
    kinds, _ = _kinds(df, counted)
    out = {"missing": missing_profile(df), "summary": _summary(df, counted, 5), "describe": _described(df, counted, numeric_cols(df)),
           "distinct": df.sparkSession.createDataFrame(list(counted.distinct.items()), "column string, n_distinct bigint"),
           "kinds": df.sparkSession.createDataFrame(list(kinds.items()), "column string, kind string"),
           "top": counted.top_values(10), "correlations": correlations(df, numeric_cols(df))}
    if target:
        out["target"] = target_summary(df, target)
    return out


_ANALYSIS = "column string, metric string, value double, detail string"


def _analysis(df: DataFrame, counted: CountedValues) -> DataFrame:
    kinds, booleans = _kinds(df, counted)
    rows, missing, distinct = counted.rows, counted.missing, counted.distinct
    out = [("__table__", "rows", float(rows), None), ("__table__", "columns", float(len(df.columns)), None)]
    for c in df.columns:
        out += [(c, "n_null", float(missing[c]), None), (c, "null_pct", missing[c] * 100.0 / rows if rows else None, None),
                (c, "n_distinct", float(distinct[c]), None), (c, "recommended_kind", None, kinds[c])]
    for c, d in counted.describe([c for c in numeric_cols(df) if c not in booleans]).items():
        out += [(c, m, None if d[m] is None else float(d[m]), None) for m in _DESCRIBED]
    table = df.sparkSession.createDataFrame(out, _ANALYSIS)
    if booleans:
        name = counted.name_of(F.col("column")).alias("column")
        counts = (counted.known_text().where(F.col("column").isin(counted._ids(booleans)))
                  .select(name, F.lit("value_count").alias("metric"), F.col("n").cast("double").alias("value"), F.col("value").alias("detail")))
        most = counted.top_values(1, booleans).select("column", F.lit("most_common").alias("metric"), F.col("n").cast("double").alias("value"), F.col("value").alias("detail"))
        table = table.unionByName(counts).unionByName(most)
    return table


def analyze(df: DataFrame) -> DataFrame:
    """Shape, missing, distinct, recommended kind, numeric detail and the value
    counts of boolean-like columns as one long table (column, metric, value, detail)."""
    return _analysis(df, counted_values(df))


def profile_report(df: DataFrame, samples: int = 5, top: int = 5) -> DataFrame:
    """The whole report as one long table (section, column, metric, value, detail):
    analysis (E03), samples (E01), top values (E07) and correlations (F01)."""
    from tabloom.operators.correlation import correlations
    counted = counted_values(df)
    none, blank = F.lit(None).cast("string"), F.lit(None).cast("double")
    types = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in df.columns], "column string, detail string")
    parts = [_analysis(df, counted).select(F.lit("analysis").alias("section"), "*"),
             types.select(F.lit("summary").alias("section"), "column", F.lit("data_type").alias("metric"), blank.alias("value"), "detail"),
             counted.first_values(samples).select(F.lit("summary").alias("section"), "column", F.lit("samples").alias("metric"), blank.alias("value"), F.col("samples").alias("detail")),
             counted.top_values(top).select(F.lit("top").alias("section"), "column", F.concat(F.lit("top_"), F.col("rank").cast("string")).alias("metric"),
                                            F.col("n").cast("double").alias("value"), F.col("value").alias("detail")),
             correlations(df, numeric_cols(df), pairs_once=True).select(F.lit("correlation").alias("section"), F.col("a").alias("column"),
                                                                        F.col("b").alias("metric"), F.col("r").alias("value"), none.alias("detail"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
