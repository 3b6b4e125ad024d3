"""Distributed running totals over a written table, without one long window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_before(rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], value: Column,
                  name: str = "before", total: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come
    earlier in the order (block, *order), and ``total``: the sum over the keys' rows.

    ``block`` splits a key's rows into runs (a partition of a range-partitioned
    table, say), so a key that holds a third of all rows is summed by many tasks:
    once inside each block, once over the block totals. ``rows`` must be a written
    table (it is read twice).
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, block).agg(F.sum(value).alias("__sum"))
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(block).alias("__block"),
                        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"),
                        F.sum("__sum").over(of_key).alias("__total"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(block).eqNullSafe(F.col("__block"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    extra = [F.col("__total").alias(total)] if total else []
    return local.join(bases, same).select(*rows.columns, (F.col("__local") + F.col("__base")).alias(name), *extra)
