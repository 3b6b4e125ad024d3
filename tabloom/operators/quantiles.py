"""Exact interpolated quantiles of any number of columns and groups, in bounded memory.

Spark's exact ``percentile``/``median`` keep every distinct value of a group in
one buffer; at 100 TB a continuous column does not fit. Here the values of all
columns are counted together (equal values are one row, combined before the
shuffle), range-partitioned by (group, column, value) and numbered by distributed
running totals; a quantile is read where its rank falls. One way for every size:
ties, hot values and groups of any cardinality take the same path, the number of
jobs does not depend on the number of columns, and only the quantiles themselves
can reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.running import totals_before
from tabloom.operators.schema import q
from tabloom.session import materialize


def known(x: Column) -> Column:
    """The value as double; NaN counts as missing, -0.0 as 0.0."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   values: dict[str, Column] | None = None) -> DataFrame:
    """(*by, column, q0, q1, ...): the quantiles ``probs`` of each column and group, as
    pandas and DuckDB's ``quantile_cont`` give them. Columns or groups without a
    known value have no row. ``values`` may give a column another expression."""
    by, cols = list(by), list(cols)
    x = {c: known((values or {}).get(c, q(c))) for c in cols}
    each = F.array(*[F.struct(F.lit(c).alias("column"), x[c].alias("value")) for c in cols])
    keys = [f"__by{i}" for i in range(len(by))]
    counts = (df.select(*[q(b).alias(k) for b, k in zip(by, keys)], F.inline(each)).where(F.col("value").isNotNull())
              .groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n")))
    ranked = materialize(counts.repartitionByRange(*keys, "column", "value").withColumn("block", F.spark_partition_id()))
    keys.append("column")
    at = totals_before(ranked, keys, "block", [F.col("value")], F.col("n"), "before", "total")
    aggs = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.least(F.floor(place) + 1, F.col("total") - 1))):
            holds = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col("value"))).alias(f"{side}{i}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"w{i}"))
    found = at.groupBy(*keys).agg(*aggs)
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "column",
                        *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}")
                          for i in range(len(probs))])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.5,),
                    values: dict[str, Column] | None = None) -> dict[str, list[float | None]]:
    """The same for a fit, from one counted table: {column: [quantile, ...]} with None
    where nothing is known."""
    from tabloom.operators.counted import counted_values
    if not cols:
        return {}
    x = {c: known((values or {}).get(c, q(c))) for c in cols}
    return counted_values(df, cols, x).quantiles(cols, probs)
