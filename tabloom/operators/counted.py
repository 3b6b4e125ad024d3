"""One table of counted values that answers all per-column questions of a fit or profile.

A frame is turned once into (column, value, n): equal values of a column are
combined before the one shuffle, and the result is written in ranges of (column,
value). Missing counts, distinct counts, levels, samples, top values, moments and
exact quantiles of every column are read from it, so a wide table is scanned once
however many of them are asked for. Ties and hot values are a single row.

The driver gets one row for each column and range (as many as there are columns and
partitions). It tells in which range a rank falls, so quantiles number the rows of
those few ranges only.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, NumericType, ShortType, StringType

from tabloom.operators.schema import q
from tabloom.session import materialize

_VALUE = ["whole", "number", "text"]


class CountedValues:
    """The counted table of a frame's columns; see ``counted_values``.

    ``table``: (column int, whole long, number double, text string, n long, block int).
    At most one of the three values is set, by the column's type; none: missing.
    """

    def __init__(self, table: DataFrame, names: Sequence[str]):
        self.table, self.names = table, list(names)

    # -- per column and range, on the driver
    @cached_property
    def blocks(self) -> dict[str, list]:
        """{column: its ranges in order}, each with block, n, missing, distinct, total
        (sum of numbers), lo, hi and semicolons (values that hold one)."""
        x = F.coalesce(F.col("whole").cast("double"), F.col("number"))
        known = F.coalesce(F.col("whole").isNotNull() | F.col("number").isNotNull() | F.col("text").isNotNull(), F.lit(False))
        rows = (self.table.groupBy("column", "block")
                .agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("missing"),
                     F.count_if(known).alias("distinct"), F.sum(x * F.col("n")).alias("total"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                     F.count_if(F.contains("text", F.lit(";"))).alias("semicolons")).collect())
        out: dict[str, list] = {c: [] for c in self.names}
        for r in sorted(rows, key=lambda r: (r["column"], r["block"])):
            out[self.names[r["column"]]].append(r)
        return out

    def _sum(self, field: str) -> dict[str, int]:
        return {c: sum(b[field] for b in bs) for c, bs in self.blocks.items()}

    @property
    def rows(self) -> int:
        return max(self._sum("n").values(), default=0)

    @property
    def missing(self) -> dict[str, int]:
        return self._sum("missing")

    @property
    def distinct(self) -> dict[str, int]:
        return self._sum("distinct")

    def with_semicolons(self) -> set[str]:
        return {c for c, n in self._sum("semicolons").items() if n}

    # -- order statistics
    def quantiles(self, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
        """Exact interpolated quantiles of the known numbers, as pandas and DuckDB's
        ``quantile_cont`` give them; None where nothing is known."""
        wanted: dict[tuple[int, int], set[int]] = {}
        places: dict[str, list[tuple]] = {}
        for c in cols:
            known = self._sum("n")[c] - self.missing[c]
            places[c] = []
            for p in probs if known else ():
                place = float(p) * (known - 1)
                ends = []
                for rank in (math.floor(place), min(math.floor(place) + 1, known - 1)):
                    for b in self.blocks[c]:
                        size = b["n"] - b["missing"]
                        if rank < size:
                            break
                        rank -= size
                    wanted.setdefault((b["column"], b["block"]), set()).add(rank)
                    ends.append((b["column"], b["block"], rank))
                places[c].append((place - math.floor(place), *ends))
        if not wanted:
            return {c: [None] * len(probs) for c in cols}
        spark = self.table.sparkSession
        asked = spark.createDataFrame([(c, b, sorted(r)) for (c, b), r in wanted.items()], "column int, block int, ranks array<long>")
        x = F.coalesce(F.col("whole").cast("double"), F.col("number"))
        inside = Window.partitionBy("column", "block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        ranked = (self.table.where(x.isNotNull()).select("column", "block", x.alias("value"), "n")
                  .join(F.broadcast(asked), ["column", "block"])                     # a row a column and rank
                  .withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))))
        held = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        at = {(r["column"], r["block"], r["rank"]): r["value"]
              for r in ranked.select("column", "block", "value", F.explode(held).alias("rank")).collect()}
        return {c: [at[lo] + (at[hi] - at[lo]) * w for w, lo, hi in places[c]] or [None] * len(probs) for c in cols}

    def traits(self, words: Sequence[str]) -> dict[str, tuple[bool, float | None]]:
        """{column: (boolean-like, integer share)}: at most four known spellings, in any
        case, and all of them in ``words``; the share of numbers within 1e-10 of an
        integer (None without numbers)."""
        spelling = F.lower("value")
        x = F.coalesce(F.col("whole").cast("double"), F.col("number"))
        near = F.when(F.abs(x - F.round(x)) < 1e-10, F.col("n")).otherwise(0)
        rows = self.known_text().groupBy("column").agg(
            F.count_if(~spelling.isin(list(words))).alias("others"),
            F.size(F.collect_set(F.when(spelling.isin(list(words)), spelling))).alias("spellings"),
            (F.sum(F.when(x.isNotNull(), near)) / F.sum(F.when(x.isNotNull(), F.col("n")))).alias("share")).collect()
        out = {c: (False, None) for c in self.names}
        for r in rows:
            out[self.names[r["column"]]] = (r["others"] == 0 and r["spellings"] <= 4, r["share"])
        return out

    # -- values of columns, as tables
    def _ids(self, cols: Collection[str]) -> list[int]:
        return [i for i, c in enumerate(self.names) if c in set(cols)]

    def values(self, cols: Collection[str]) -> DataFrame:
        """(column int, whole, number, text, n) of some columns, missing included."""
        return self.table.where(F.col("column").isin(self._ids(cols))).select("column", *_VALUE, "n")

    def name_of(self, column: Column) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in self.names]), column + 1)

    def known_text(self) -> DataFrame:
        """(column int, whole, number, value, n): known values, ``value`` as text."""
        value = F.coalesce(F.col("whole").cast("string"), F.col("number").cast("string"), F.col("text"))
        return self.table.select("column", "whole", "number", value.alias("value"), "n").where(F.col("value").isNotNull())

    def numbered(self) -> DataFrame:
        """(column, value as text, n, code, before, total): known values with their place
        among the column's sorted values, from 0, and the rows that hold a smaller one.
        Ranges are numbered apart and shifted by what stands before them."""
        starts = []
        for c, bs in self.blocks.items():
            code, before, total = 0, 0, sum(b["n"] - b["missing"] for b in bs)
            for b in bs:
                starts.append((b["column"], b["block"], c, code, before, total))
                code, before = code + b["distinct"], before + b["n"] - b["missing"]
        first = self.table.sparkSession.createDataFrame(starts, "column int, block int, name string, code0 long, before0 long, total long")
        value = F.coalesce(F.col("whole").cast("string"), F.col("number").cast("string"), F.col("text"))
        order = Window.partitionBy("column", "block").orderBy(*_VALUE)
        sofar = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (self.table.withColumn("value", value).where(F.col("value").isNotNull())
                .select("column", "block", "value", "n", (F.row_number().over(order) - 1).alias("code"), sofar.alias("before"))
                .join(F.broadcast(first), ["column", "block"])                          # a row a column and range
                .select(F.col("name").alias("column"), "value", "n", (F.col("code") + F.col("code0")).alias("code"),
                        (F.col("before") + F.col("before0")).alias("before"), "total"))

    def first_values(self, n: int, sep: str = ", ") -> DataFrame:
        """(column, samples): the n smallest known values of each column, joined."""
        order = Window.partitionBy("column").orderBy("whole", "number", "value")     # limited in every task before the shuffle
        first = self.known_text().withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        listed = first.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("firsts"))
        return listed.select(self.name_of(F.col("column")).alias("column"), F.array_join(F.col("firsts.value"), sep).alias("samples"))

    def top_values(self, n: int, cols: Collection[str] | None = None) -> DataFrame:
        """(column, rank, value, n): the n commonest known values of each column, ties to
        the smaller."""
        order = Window.partitionBy("column").orderBy(F.desc("n"), "whole", "number", "value")
        rows = self.known_text()
        if cols is not None:
            rows = rows.where(F.col("column").isin(self._ids(cols)))
        return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
                .select(self.name_of(F.col("column")).alias("column"), "rank", "value", "n"))

    def describe(self, cols: Sequence[str]) -> dict[str, dict]:
        """{column: count, mean, std (sample), min, q25, median, q75, max} of the known
        numbers; squares are taken about the mean, so no digits cancel."""
        out = {}
        for c in cols:
            bs = [b for b in self.blocks[c] if b["total"] is not None]
            n = sum(b["n"] - b["missing"] for b in bs)
            out[c] = {"count": n, "mean": math.fsum(b["total"] for b in bs) / n if n else None, "std": None,
                      "min": min((b["lo"] for b in bs), default=None), "max": max((b["hi"] for b in bs), default=None)}
        means = [(i, out[c]["mean"]) for i, c in enumerate(self.names) if c in out and out[c]["mean"] is not None]
        if means:
            x = F.coalesce(F.col("whole").cast("double"), F.col("number"))
            away = x - F.col("mean")
            mean_of = F.broadcast(self.table.sparkSession.createDataFrame(means, "column int, mean double"))
            for r in self.table.join(mean_of, "column").groupBy("column").agg(F.sum(away * away * F.col("n")).alias("squares")).collect():
                d = out[self.names[r["column"]]]
                d["std"] = math.sqrt(r["squares"] / (d["count"] - 1)) if d["count"] > 1 else None
        for c, three in self.quantiles(cols, (0.25, 0.5, 0.75)).items():
            out[c].update(zip(("q25", "median", "q75"), three))
        return out


def counted_values(df: DataFrame, cols: Sequence[str] | None = None, values: dict[str, Column] | None = None,
                   presence: Collection[str] = ()) -> CountedValues:
    """Count the values of ``cols`` (all by default).

    Integers stay exact; other numbers are doubles with NaN as missing and -0.0 as
    0.0; everything else is text. Columns in ``presence`` count only as known or
    missing. ``values`` may give a column another (numeric) expression.
    """
    cols, values, presence = list(df.columns if cols is None else cols), values or {}, set(presence)
    each = []
    for i, c in enumerate(cols):
        t = None if c in values else df.schema[c].dataType
        whole, number, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        floating = c in values or isinstance(t, NumericType) and not isinstance(t, (LongType, IntegerType, ShortType, ByteType))
        x = values.get(c, q(c))
        if floating:
            x = x.cast("double")
            x = F.when(~F.isnan(x), x + F.lit(0.0))
        if c in presence:
            text = F.when(x.isNotNull(), F.lit(""))
        elif floating:
            number = x
        elif isinstance(t, NumericType):
            whole = x.cast("long")
        elif isinstance(t, StringType):
            text = x
        else:
            text = x.cast("string")
        each.append(F.struct(F.lit(i).alias("column"), whole.alias("whole"), number.alias("number"), text.alias("text")))
    if not each:
        return CountedValues(df.sparkSession.createDataFrame([], "column int, whole long, number double, text string, n long, block int"), [])
    counts = df.select(F.inline(F.array(*each))).groupBy("column", *_VALUE).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("column", *_VALUE).withColumn("block", F.spark_partition_id())
    return CountedValues(materialize(ranged), cols)
