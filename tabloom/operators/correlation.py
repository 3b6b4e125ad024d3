"""Correlation and collinearity.

Sums of products of all column pairs are one Gramian: rows become vectors and each
task adds up a packed triangle in the JVM, merged as a tree (Spark's ``RowMatrix``),
so one matrix a task moves whatever the number of rows, and hundreds of columns need
no generated code per pair. Correlations use pairwise-complete rows, like pandas;
Gramians complete rows. Only p x p matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.quantiles import known
from tabloom.operators.schema import q


def _products(df: DataFrame, xs: Sequence[Column]) -> np.ndarray:
    """Sums over the rows of the products of all pairs of ``xs`` (never null)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*xs)).alias("row")))
    return RowMatrix(rows, 0, len(xs)).computeGramianMatrix().toArray()


def pair_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, np.ndarray]:
    """Over the rows in which both columns are known, for every pair (i, j): number n,
    sum s of column i, sum sq of its squares, sum prod of products; values are taken
    about the columns' means, so no digits cancel.

    Rows become (1, x); where columns have missing values, also their masks and all
    squares, since only then do these sums depend on the other column.
    """
    p = len(cols)
    values = df.select(*[known(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    seen = values.agg(F.count(F.lit(1)), *[F.avg(f"c{i}") for i in range(p)], *[F.count(f"c{i}") for i in range(p)]).first()
    means, gaps = [m or 0.0 for m in seen[1:p + 1]], [i for i in range(p) if seen[p + 1 + i] < seen[0]]
    x = [F.coalesce(F.col(f"c{i}") - F.lit(float(means[i])), F.lit(0.0)) for i in range(p)]
    masks = [F.col(f"c{i}").isNotNull().cast("double") for i in gaps]
    g = _products(values, [F.lit(1.0), *x, *masks, *([c * c for c in x] if gaps else [])])
    there = np.zeros(p, dtype=int)                               # the row of a column's mask; 0: the ones
    there[gaps] = 1 + p + np.arange(len(gaps))
    own = np.arange(1, p + 1)
    squares = g[np.ix_(1 + p + len(gaps) + np.arange(p), there)] if gaps else np.repeat(np.diag(g)[own][:, None], p, axis=1)
    return {"n": g[np.ix_(there, there)], "s": g[np.ix_(own, there)], "sq": squares, "prod": g[np.ix_(own, own)]}


# F01 / F06 -------------------------------------------------------------------
def correlations(df: DataFrame, cols: Sequence[str], pairs_once: bool = False) -> DataFrame:
    """Long form (a, b, r) over all ordered pairs (or each unordered pair once); NaN if
    one side does not vary, null without a common row."""
    cols = list(cols)
    out = [] if pairs_once else [(c, c, 1.0) for c in cols]
    if len(cols) > 1:
        m = pair_moments(df, cols)
        n = np.where(m["n"] > 0, m["n"], 1.0)
        var_i = m["sq"] - m["s"] ** 2 / n
        flat = (var_i <= m["sq"] * 1e-13) | (var_i <= m["sq"] * 1e-13).T
        with np.errstate(all="ignore"):
            r = np.where(flat, np.nan, (m["prod"] - m["s"] * m["s"].T / n) / np.sqrt(var_i * var_i.T))
        for i, j in zip(*np.triu_indices(len(cols), 1)):
            value = float(r[i, j]) if m["n"][i, j] > 0 else None
            out += [(cols[i], cols[j], value)] + ([] if pairs_once else [(cols[j], cols[i], value)])
    return df.sparkSession.createDataFrame(out, "a string, b string, r double")


# F02 -----------------------------------------------------------------------
def top_correlations(df: DataFrame, cols: Sequence[str], k: int = 15) -> DataFrame:
    c = correlations(df, cols, pairs_once=True).where(F.abs("r") < 1)
    return c.orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


# F03 -----------------------------------------------------------------------
def high_correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    return correlations(df, cols, pairs_once=True).where(F.abs("r") > threshold)


# F04 -----------------------------------------------------------------------
def removal_candidates(high: DataFrame) -> DataFrame:
    """How often each column appears in a high pair."""
    return (high.select(F.explode(F.array("a", "b")).alias("column")).groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_pairs")))


# F05 -----------------------------------------------------------------------
def gramian(df: DataFrame, cols: Sequence[str | Column]) -> tuple[np.ndarray, int]:
    """X'X over the rows in which all ``cols`` are finite, and the number of rows."""
    p = len(cols)
    x = df.select(*[known(q(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(cols)])
    finite = F.forall(F.array(*[F.col(f"c{i}") for i in range(p)]), lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    g = _products(x.where(finite), [F.lit(1.0), *[F.col(f"c{i}") for i in range(p)]])
    return g[1:, 1:], int(round(g[0, 0]))


def vif(df: DataFrame, cols: Sequence[str], flag_above: float = 10.0) -> DataFrame:
    """VIF_j = 1 / (1 - R_j^2) of column j on the others without intercept. Columns are
    scaled to length one first; those in an exact linear dependency (and columns of
    zeros) get infinity, the others keep their value. Needs more complete rows than
    columns."""
    cols = list(cols)
    g, n = gramian(df, cols)
    if n <= len(cols):
        raise ValueError(f"VIF needs more rows ({n}) than columns ({len(cols)})")
    length = np.sqrt(np.diag(g))
    unit = g / np.outer(np.where(length > 0, length, 1.0), np.where(length > 0, length, 1.0))
    values, vectors = np.linalg.eigh(unit)
    null = values <= len(cols) * 1e-13 * values.max()
    dependent = (vectors[:, null] ** 2).sum(axis=1) > 1e-8
    inverse = ((vectors[:, ~null] ** 2) / values[~null]).sum(axis=1)
    found = np.where(dependent, np.inf, inverse)
    rows = [(c, float(v), int(v > flag_above)) for c, v in zip(cols, found)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, high int")
