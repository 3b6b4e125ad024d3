"""As-of join: each row meets the last row of a table at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import materialize


def last_at_or_before(left: DataFrame, right: DataFrame, by: Sequence[str], on: str) -> DataFrame:
    """The rows of ``left`` with the other columns of the last row of ``right`` that has the
    same ``by`` and an ``on`` not larger than theirs; nulls where there is none.

    Both are ordered together: range-partitioned by (by, on) and carried along inside
    each range, then from range to range by one row each, so neither side is
    broadcast, no pairs are formed and no group meets in one task. Keys are matched
    with null as a value; of several right rows at one place any one may be taken.
    """
    by, took = list(by), [c for c in right.columns if c not in (*by, on)]
    row, met = F.struct(*left.columns), F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(took)])
    empty_row, empty_met = left.select(row.alias("x")).schema["x"].dataType, right.select(met.alias("x")).schema["x"].dataType
    both = (right.select(*by, on, F.lit(0).alias("_side"), F.lit(None).cast(empty_row).alias("_row"), met.alias("_met"))
            .unionByName(left.select(*by, on, F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(empty_met).alias("_met"))))
    ranged = materialize(both.repartitionByRange(*by, on, "_side").withColumn("_block", F.spark_partition_id()))
    ends = ranged.groupBy(*by, "_block").agg(F.max_by("_met", F.when(F.col("_side") == 0, F.struct(on))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_block").alias("_at"),
                          F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("_here", F.last("_met", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    same = F.col("_block") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    found = here.join(carried, same, "left").select("_row", F.coalesce("_here", "_carried").alias("_found"))
    return found.select("_row.*", *[F.col("_found")[f"r{i}"].alias(c) for i, c in enumerate(took)])
