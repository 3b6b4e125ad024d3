"""Prefix sums over a table of any length, without one long window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage


def in_order(rows: DataFrame, *order: Column, run: str = "run") -> DataFrame:
    """The rows as a written table in runs that follow the order: every row of a run
    comes before every row of the next. Give columns that tell rows apart, or equal
    rows share one run."""
    return stage(rows.repartitionByRange(*order).withColumn(run, F.spark_partition_id()))


def prefix_sums(rows: DataFrame, sums: dict[str, Column], order: Sequence[Column], keys: Sequence[str] = (),
                run: str = "run") -> DataFrame:
    """Add each of ``sums`` (name: value): the value summed over the rows of the same
    ``keys`` that come earlier by (run, *order), 0 for the first.

    A key's rows are summed run by run in separate tasks and shifted by the sums of
    the runs before, so a key that holds a third of all rows is no single task's
    work. Null keys are a key. ``rows`` is read twice: give a written table. An
    empty table stays empty; further columns stay as they are.
    """
    names, keys = list(sums), list(keys)
    taken = set(rows.columns) | set(names)
    whole = {n: free_name(taken, f"{n}_run") for n in names}
    base = {n: free_name(taken, f"{n}_base") for n in names}
    key_copy = {k: free_name(taken, f"{k}_of") for k in [*keys, run]}
    before = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*keys, run).agg(*[F.sum(sums[n]).alias(whole[n]) for n in names]).select(
        *[F.col(k).alias(c) for k, c in key_copy.items()],
        *[F.coalesce(F.sum(whole[n]).over(before), F.lit(0)).alias(base[n]) for n in names])
    inside = Window.partitionBy(*keys, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(sums[n]).over(inside), F.lit(0)).alias(n) for n in names])
    same = [F.col(k).eqNullSafe(F.col(c)) for k, c in key_copy.items()]
    joined = local.join(bases, same)
    return joined.select(*[c for c in rows.columns if c not in sums], *[(F.col(n) + F.col(base[n])).alias(n) for n in names])
