"""Set operations, sampling and category augmentation.

Sampling, splits and folds order rows by ``mix32(key, seed)`` (a portable,
deterministic integer hash; no ``rand()``), tie-broken by the key.

``cover_categories`` (K02) draws up to ``n`` rows per missing (column, value)
without a global sort and without sending a hot group to one task: candidates
are first cut to the ``n`` smallest hashes inside (column, value, bucket) with
``bucket = hash % salt``, then to ``n`` inside (column, value), so a value held
by a third of all rows is ranked in ``salt`` pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32, row_key
from tabloom.operators.schema import q


def _pairs(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    ids = [q(key).alias("_key")] if key else []
    long = df.select(*ids, *[q(c).cast("string").alias(c) for c in cols]).unpivot(
        ["_key"] if key else [], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull())


# K01 -----------------------------------------------------------------------
def missing_categories(sample: DataFrame, full: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) present in ``full`` and absent from ``sample``."""
    return _pairs(full, cols).distinct().join(_pairs(sample, cols).distinct(), ["column", "value"], "left_anti")


def missing_category_stats(sample: DataFrame, full: DataFrame, cols: Sequence[str]) -> DataFrame:
    f = _pairs(full, cols).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("total_in_full"))
    s = _pairs(sample, cols).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("in_sample"))
    m = missing_categories(sample, full, cols).groupBy("column").agg(F.count(F.lit(1)).alias("missing_count"))
    return (f.join(s, "column", "left").join(m, "column", "left")
            .select("column", F.col("total_in_full").cast("bigint"),
                    F.coalesce("in_sample", F.lit(0)).cast("bigint").alias("in_sample"),
                    F.coalesce("missing_count", F.lit(0)).cast("bigint").alias("missing_count")))


# K02 / K03 / K07 ---------------------------------------------------------------
def sample_per_group(rows: DataFrame, group: Sequence[str], n: int, seed: int) -> DataFrame:
    """Up to n rows per group with the smallest (hash, key). Spark limits the ranking in
    every task before the shuffle (WindowGroupLimit), so at most n rows a group and
    task move, also of a group that holds a third of all rows."""
    order = Window.partitionBy(*group).orderBy("_h", "_key")
    return (rows.withColumn("_h", mix32(F.col("_key"), seed)).withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") <= n).drop("_r"))


def cover_categories(sample: DataFrame, full: DataFrame, cols: Sequence[str], key: str, n: int = 5,
                     exclude: Sequence[str] = (), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of ``full`` for categories the sample lacks: (enhanced sample, added rows).

    n rows per missing (column, value); after sampling, rows whose excluded
    column would add a level the sample lacks are dropped (null allowed); the
    added rows are de-duplicated and appended to the sample."""
    cols = [c for c in cols if c not in set(exclude)]
    # first at most n rows of every value, then the values that the sample lacks: one scan of full
    firsts = sample_per_group(_pairs(full, cols, key), ["column", "value"], n, seed)
    picked = firsts.join(_pairs(sample, cols).distinct(), ["column", "value"], "left_anti").select("_key").distinct()
    rows = full.join(picked, q(key) == F.col("_key"), "left_semi")
    for ex in exclude:
        existing = sample.select(q(ex).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        ok = rows.join(existing, q(ex) == F.col("_v"), "left_semi")
        rows = ok.unionByName(rows.where(q(ex).isNull()))
    added = rows.dropDuplicates()
    return sample.unionByName(added), added


def semi_filter(df: DataFrame, other: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` value exists in ``other`` or is null."""
    existing = other.select(q(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    return df.join(existing, q(col) == F.col("_v"), "left_semi").unionByName(df.where(q(col).isNull()))


# K04 -----------------------------------------------------------------------
def new_categories(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value): every category that only ``after`` has."""
    return _pairs(after, cols).distinct().join(_pairs(before, cols).distinct(), ["column", "value"], "left_anti")


def category_coverage(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_before, n_after, n_new): distinct categories before, after and new."""
    nb = _pairs(before, cols).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_before"))
    na = _pairs(after, cols).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_after"))
    nn = new_categories(before, after, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_new"))
    return (na.join(nb, "column", "full").join(nn, "column", "left")
            .select("column", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_before", "n_after", "n_new")]))


# K08 / K09 / K10 ---------------------------------------------------------------
def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows with the smallest (hash, key): a bounded top-n, no global sort."""
    return df.withColumn("_h", mix32(row_key(df, key), seed)).orderBy("_h", q(key)).limit(n).drop("_h")


def split(df: DataFrame, fraction: float, key: str, seed: int = 123, name: str = "split") -> DataFrame:
    """Adds ``name`` = 'train' when pmod(hash, 10000) < fraction*10000, else 'holdout'."""
    cut = int(round(fraction * 10000))
    return df.withColumn(name, F.when(F.pmod(mix32(row_key(df, key), seed), F.lit(10000)) < cut, "train").otherwise("holdout"))


def folds(df: DataFrame, k: int, key: str, seed: int = 123, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(mix32(row_key(df, key), seed), F.lit(k)).cast("int"))


# K11 -----------------------------------------------------------------------
def append(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
