"""Missing values.

Every profile is ONE aggregate over all columns (map-side partial aggregation,
one row to the driver) followed by ``stack`` to long form. Fill operators are
fitted: ``fit`` runs that one aggregate and keeps a small plan (columns to drop,
fill values), ``transform`` is a single lazy ``select``.

NaN is missing like null: no statistic sees it, and fills replace it. Medians are
exact at every size (``tabloom.operators.quantiles``, one distributed pass for
all columns); ``median="approx"`` takes a ``percentile_approx`` sketch instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, DoubleType, FloatType

from tabloom.operators.counted import counted_values
from tabloom.operators.quantiles import exact_quantiles, known
from tabloom.operators.schema import q


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def is_missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN for floating columns (pandas treats both as missing)."""
    t = df.schema[c].dataType
    if isinstance(t, (DoubleType, FloatType)):
        return q(c).isNull() | F.isnan(q(c))
    return q(c).isNull()


def long_form(wide: DataFrame, cols: Sequence[str], prefixes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Unpivot a one-row wide aggregate ``{prefix}{i}`` into (column, *names)."""
    args = []
    for i, c in enumerate(cols):
        args.append(F.lit(c))
        args += [F.col(f"{p}{i}") for p in prefixes]
    return wide.select(F.stack(F.lit(len(cols)), *args).alias("column", *names))


def value(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(q(c)), q(c)) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else q(c)


def fitted_medians(df: DataFrame, cols: Sequence[str], median: str = "exact",
                   values: dict[str, Column] | None = None) -> dict[str, float | None]:
    """{column: median of its known values}, None if there is none."""
    x = {c: known((values or {}).get(c, q(c))) for c in cols}
    if median == "approx" and cols:
        row = df.agg(*[F.percentile_approx(x[c], 0.5, 10000).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(cols)}
    return {c: m[0] for c, m in exact_quantiles(df, cols, [0.5], x).items()}


# D01 / D09 -------------------------------------------------------------------
def missing_profile(df: DataFrame) -> DataFrame:
    """(column, n_missing, missing_frac) for every column, from one aggregate."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    args = []
    for i, c in enumerate(cols):
        args += [F.lit(c), F.col(f"m{i}")]
    return wide.select("_rows", F.stack(F.lit(len(cols)), *args).alias("column", "n_missing")).select(
        "column", F.col("n_missing").cast("bigint").alias("n_missing"),
        (F.col("n_missing") / F.col("_rows")).alias("missing_frac"))


def missing_summary(profile: DataFrame, threshold: float = 0.7) -> DataFrame:
    return profile.agg(
        F.count_if(F.col("missing_frac") > 0.5).cast("bigint").alias("above_half"),
        F.count_if(F.col("missing_frac") > threshold).cast("bigint").alias("above_threshold"),
        F.count_if(F.col("n_missing") > 0).cast("bigint").alias("with_missing"))


# D02 / D03 / D04 -------------------------------------------------------------
@dataclass
class FittedMissing:
    drop: list[str]
    text_fill: str
    numeric_fill: dict[str, float]
    text_columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.drop:
                continue
            if c in self.numeric_fill and self.numeric_fill[c] is not None:
                out.append(F.coalesce(value(df, c), F.lit(self.numeric_fill[c]).cast(df.schema[c].dataType)).alias(c))
            elif isinstance(df.schema[c].dataType, StringType):
                out.append(F.coalesce(q(c), F.lit(self.text_fill)).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)

    def to_json(self) -> dict:
        return {"drop": self.drop, "text_fill": self.text_fill, "numeric_fill": self.numeric_fill}


class MissingHandler:
    """Drop columns missing above ``threshold`` (unless in ``keep``), fill text
    with ``fill_value`` and numerics with the fitted median."""

    def __init__(self, threshold: float = 0.7, keep: Iterable[str] = (), fill_value: str = "missing",
                 median: str = "exact"):
        """``median``: "exact", or "approx" (a sketch)."""
        self.threshold, self.keep, self.fill_value, self.median = threshold, set(keep), fill_value, median

    def fit(self, df: DataFrame) -> FittedMissing:
        nums, exact = numeric_cols(df), self.median == "exact"
        counted = counted_values(df, presence=[c for c in df.columns if c not in nums or not exact])
        n = counted.rows or 1
        drop = [c for c, m in counted.missing.items() if m / n > self.threshold and c not in self.keep]
        kept = [c for c in nums if c not in drop]
        fills = {c: m[0] for c, m in counted.quantiles(kept, [0.5]).items()} if exact else fitted_medians(df, kept, self.median)
        return FittedMissing(drop, self.fill_value, fills, text_cols(df))


# D05 -----------------------------------------------------------------------
def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most common value per text column (count desc, value asc), computed with
    aggregates only: (column, value) counts with map-side combine, the max count
    per column, then the smallest value holding it. No per-column sort in one task."""
    if not cols:
        return {}
    long = df.select(*[q(c) for c in cols]).unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.max("n").alias("n"))
    top = counts.join(best, ["column", "n"]).groupBy("column").agg(F.min("value").alias("mode"))
    return {r["column"]: r["mode"] for r in top.collect()}


class SimpleImputer:
    """Numeric mean + text mode."""

    def fit(self, df: DataFrame) -> FittedMissing:
        nums, txt = numeric_cols(df), text_cols(df)
        means = {}
        if nums:
            row = df.agg(*[F.avg(value(df, c)).alias(f"a{i}") for i, c in enumerate(nums)]).first()
            means = {c: row[f"a{i}"] for i, c in enumerate(nums)}
        modes = column_modes(df, txt)
        return FittedImpute(means, modes)


@dataclass
class FittedImpute:
    means: dict[str, float]
    modes: dict[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if self.means.get(c) is not None:
                out.append(F.coalesce(value(df, c), F.lit(self.means[c]).cast(df.schema[c].dataType)).alias(c))
            elif c in self.modes:
                out.append(F.coalesce(q(c), F.lit(self.modes[c])).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)


# D06 / D07 -------------------------------------------------------------------
def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def clean_numeric(df: DataFrame, strategy: str = "mean", exclude: Iterable[str] = (),
                  approx: bool = False) -> DataFrame:
    """±inf -> null, then fill with the column mean/median; all-null columns dropped."""
    exclude = set(exclude)
    nums = [c for c in numeric_cols(df) if c not in exclude]
    fin = {c: finite(q(c).cast("double")) for c in nums}
    if strategy == "mean" and nums:
        row = df.agg(*[F.avg(fin[c]).alias(f"s{i}") for i, c in enumerate(nums)]).first()
        stat = {c: row[f"s{i}"] for i, c in enumerate(nums)}
    else:
        stat = fitted_medians(df, nums, "approx" if approx else "exact", fin)
    out = []
    for c in df.columns:
        if c in stat:
            if stat[c] is None:
                continue
            out.append(F.coalesce(fin[c], F.lit(float(stat[c]))).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


# D08 -----------------------------------------------------------------------
def zero_fill(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(value(df, c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
                       if isinstance(df.schema[c].dataType, NumericType) else q(c) for c in df.columns])


# D10 -----------------------------------------------------------------------
def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(pattern, n): one bit per column ('1' = missing), counted."""
    cols = list(cols or df.columns)
    bits = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in cols])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


# D11 -----------------------------------------------------------------------
def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_cols(df))
    cond = F.lit(True)
    for c in cols:
        v = q(c).cast("double")
        cond = cond & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.where(cond)
