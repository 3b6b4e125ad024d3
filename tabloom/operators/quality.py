"""Cleaning checks.

All three work on the distinct (column, value) pairs of the checked columns,
de-duplicated with map-side combine, then one aggregate per column: the check
cost is bounded by the number of distinct values, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import FORMAT_RULES, strip_ws
from tabloom.operators.schema import q


def _distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = df.select(*[q(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "v")
    return long.where(F.col("v").isNotNull()).distinct()


# C14 -----------------------------------------------------------------------
def verify_multivalue(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_values, n_unsorted_or_dup, n_bad_separator, n_untrimmed) over distinct values."""
    v = F.col("v")
    raw = F.split(v, ";")
    stripped = F.transform(raw, lambda x: strip_ws(x))
    multi = F.contains(v, F.lit(";"))
    return _distinct_values(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_values"),
        F.count_if(multi & (stripped != F.array_sort(F.array_distinct(stripped)))).cast("bigint").alias("n_unsorted_or_dup"),
        F.count_if(multi & ~F.contains(v, F.lit("; "))).cast("bigint").alias("n_bad_separator"),
        F.count_if(multi & F.exists(raw, lambda x: x != strip_ws(x))).cast("bigint").alias("n_untrimmed"))


# C15 -----------------------------------------------------------------------
def format_issues(df: DataFrame, cols: Sequence[str], rules=FORMAT_RULES) -> DataFrame:
    """(column, rule, n, sample): distinct values still matching a format rule."""
    vals = _distinct_values(df, cols)
    hits = vals.select("column", "v", F.explode(F.array(*[
        F.when(F.col("v").rlike(rx), F.lit(name)) for name, rx in rules])).alias("rule")).where(F.col("rule").isNotNull())
    return hits.groupBy("column", "rule").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min("v").alias("sample"))


# C16 -----------------------------------------------------------------------
def cleaning_effect(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_before, n_after): distinct non-null values before and after cleaning."""
    b = _distinct_values(before, cols).groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("n_before"))
    a = _distinct_values(after, cols).groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("n_after"))
    return b.join(a, "column", "full").select(
        "column", F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"),
        F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after"))
