"""Cross-validated linear models from fold Gramians: one scan for any number of specs.

A fold's training rows are all rows but its own, so their sums of products are the
total less the fold's. One pass gives the sums of (1, x, y) for every fold; from them
least squares, ridge, lasso, elastic net and the mean model are solved for each fold on
the driver (p x p), and a second pass scores all specs on the rows left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.metrics import regression_metrics
from tabloom.operators.schema import q

#: Spec: (regularisation, share of it that is L1), as Spark's LinearRegression takes them.
LINEAR_SPECS = {"lr": (0.0, 0.0), "ols": (0.0, 0.0), "ridge": (1.0, 0.0), "en": (1.0, 0.5), "lasso": (1.0, 1.0), "dummy": None}
_WIDTH = 2048                # columns of one Gramian: folds are taken in batches of so many


def fold_sums(df: DataFrame, label: str, features: Sequence[str], fold_col: str, k: int) -> np.ndarray:
    """[fold, :, :]: sums of products of (1, features, label) over each fold's rows in
    which all of them are finite. Rows become sparse vectors whose place tells the
    fold, so one tree-aggregated Gramian holds the folds as its diagonal blocks."""
    from pyspark.ml.feature import Interaction, VectorAssembler
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    size = len(features) + 2
    batch = max(1, _WIDTH // size)
    xs = [f"x{i}" for i in range(size)]
    values = df.select(*[c.cast("double").alias(x) for c, x in zip([F.lit(1.0), *map(q, features), q(label)], xs)], F.col(fold_col).alias("fold"))
    finite = F.forall(F.array(*xs), lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    values = values.where(finite)
    out = np.zeros((k, size, size))
    for first in range(0, k, batch):
        folds = list(range(first, min(first + batch, k)))
        rows = values.where(F.col("fold").between(folds[0], folds[-1])).select(
            *xs, *[(F.col("fold") == f).cast("double").alias(f"f{f}") for f in folds])
        rows = VectorAssembler(inputCols=[f"f{f}" for f in folds], outputCol="place").transform(rows)
        rows = VectorAssembler(inputCols=xs, outputCol="x").transform(rows)
        rows = Interaction(inputCols=["place", "x"], outputCol="row").transform(rows).select("row")
        g = RowMatrix(MLUtils.convertVectorColumnsFromML(rows), 0, size * len(folds)).computeGramianMatrix().toArray()
        for i, f in enumerate(folds):
            out[f] = g[i * size:(i + 1) * size, i * size:(i + 1) * size]
    return out


def _shrunk(r: np.ndarray, to: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinate descent for w'Rw/2 - to'w + l1 |w|_1 + l2 |w|^2 / 2, to convergence."""
    w, grip = np.zeros(len(to)), np.diag(r) + l2
    while True:
        most = 0.0
        for j in range(len(to)):
            if grip[j] <= 0:
                continue
            pull = to[j] - r[j] @ w + r[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / grip[j]
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most <= 1e-12 * max(1.0, np.abs(w).max(initial=0.0)):
            return w


def solve(sums: np.ndarray, reg: float = 0.0, l1_share: float = 0.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) from the sums of products of (1, x, y).

    The penalty is Spark's: on standardised features and label, not on the intercept.
    Constant features get 0; exactly dependent ones share their weight (the solution
    of least length) when nothing is penalised. No rows: zeros."""
    p, n = len(sums) - 2, sums[0, 0]
    if n <= 0:
        return np.zeros(p), 0.0
    mean = sums[0] / n
    cov = sums / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    flat = spread <= 1e-9 * np.maximum(np.abs(mean), 1e-300)
    spread[flat] = 0.0
    live = [j for j in range(1, p + 1) if spread[j] > 0]
    beta = np.zeros(p)
    if live and spread[-1] > 0:
        scale = np.array([spread[j] for j in live])
        r, to = cov[np.ix_(live, live)] / np.outer(scale, scale), cov[live, -1] / (scale * spread[-1])
        strength = reg / spread[-1]
        if l1_share > 0 and reg > 0:
            w = _shrunk(r, to, strength * l1_share, strength * (1 - l1_share))
        else:
            w = np.linalg.lstsq(r + strength * np.eye(len(live)), to, rcond=1e-12)[0]
        beta[np.array(live) - 1] = w * spread[-1] / scale
    return beta, float(mean[-1] - beta @ mean[1:-1])


def fold_models(sums: np.ndarray, specs: Sequence[str]) -> list[tuple[str, int, list[float], float]]:
    """(spec, fold, coefficients, intercept), fitted on the rows of all other folds."""
    total, out = sums.sum(axis=0), []
    for spec in specs:
        for f in range(len(sums)):
            rest = total - sums[f]
            if LINEAR_SPECS[spec] is None:
                beta, at = np.zeros(len(rest) - 2), float(rest[0, -1] / rest[0, 0]) if rest[0, 0] else 0.0
            else:
                beta, at = solve(rest, *LINEAR_SPECS[spec])
            out.append((spec, f, [float(b) for b in beta], at))
    return out


def fold_predictions(df: DataFrame, features: Sequence[str], fold_col: str, models: Sequence[tuple], keep: Sequence[str]) -> DataFrame:
    """(*keep, model, fold, _pred): every row scored by each spec's model of its own fold,
    the one that has not seen it. Missing features count as 0, as in LinearScorer."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(models), "model string, at_fold int, coefs array<double>, intercept double")     # specs x folds rows
    x = F.array(*[F.coalesce(q(f).cast("double"), F.lit(0.0)) for f in features]).cast("array<double>")
    products = F.zip_with(F.col("_x"), F.col("coefs"), lambda a, b: a * b)
    pred = F.aggregate(products, F.col("intercept"), lambda s, v: s + v)
    return (df.select(*[q(c) for c in keep], F.col(fold_col).alias("fold"), x.alias("_x"))
            .join(F.broadcast(table), F.col("fold") == F.col("at_fold"))
            .select(*[q(c) for c in keep], "model", "fold", pred.alias("_pred")))


def cross_validate_linear(df: DataFrame, label: str, features: Sequence[str], specs: Sequence[str], k: int = 10,
                          fold_col: str = "_fold") -> DataFrame:
    """Fold scores (see ``regression_metrics``) of any of ``LINEAR_SPECS``: one pass for
    the sums, one for the scores, whatever the number of specs and folds."""
    models = fold_models(fold_sums(df, label, features, fold_col, k), specs)
    return regression_metrics(fold_predictions(df, features, fold_col, models, [label]), label, "_pred", ["model", "fold"])
