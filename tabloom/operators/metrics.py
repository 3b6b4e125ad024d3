"""Scores and prediction summaries.

Every metric is one aggregate of sums per group (map-side partial
aggregation); ensembles are array expressions on the row (no UDF).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.quantiles import known, quantile_table
from tabloom.operators.running import totals_before
from tabloom.operators.schema import q
from tabloom.session import materialize

METRICS = ["MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE"]


# M05 -----------------------------------------------------------------------
def metric_columns(label: str, pred: str) -> dict[str, Column]:
    """{metric: its aggregate}, for ``regression_metrics`` or to score several predictions of
    the rows side by side."""
    y, p = q(label).cast("double"), q(pred).cast("double")
    e = p - y
    n, var = F.count(F.lit(1)), F.var_pop(y)
    return {"n": n.cast("bigint"), "MAE": F.avg(F.abs(e)), "MSE": F.avg(e * e), "RMSE": F.sqrt(F.avg(e * e)),
            "R2": F.when(var > 0, 1 - F.sum(e * e) / (n * var)),
            "RMSLE": F.sqrt(F.avg(F.pow(F.log1p(F.abs(p)) - F.log1p(F.abs(y)), 2))),
            "MAPE": F.avg(F.when(y != 0, F.abs(e) / F.abs(y)))}


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, R2, RMSLE, MAPE (per group).

    R2 = 1 - SSE / (n * var_pop(y)) (stable variance aggregate). RMSLE is taken
    on log1p(|x|) so negative predictions do not fail; MAPE skips zero targets."""
    aggs = [c.alias(m) for m, c in metric_columns(label, pred).items()]
    return df.groupBy(*[q(c) for c in by]).agg(*aggs) if by else df.agg(*aggs)


# M06 -----------------------------------------------------------------------
def fold_summary(scores: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
                 metrics: Sequence[str] = METRICS) -> DataFrame:
    """Fold rows plus 'Mean' and 'Std' (population std) rows per model."""
    base = scores.select(*by, F.col(fold).cast("string").alias("fold"), *metrics)
    mean = scores.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("fold", F.lit("Mean"))
    std = scores.groupBy(*by).agg(*[F.stddev_pop(m).alias(m) for m in metrics]).withColumn("fold", F.lit("Std"))
    return base.unionByName(mean).unionByName(std)


# M07 -----------------------------------------------------------------------
def leaderboard(scores: DataFrame, metric: str = "R2", n: int = 3, model: str = "model") -> DataFrame:
    """Top n models: R2/others descending except error metrics (lower is better)."""
    lower_better = metric.upper() in {"MAE", "MSE", "RMSE", "RMSLE", "MAPE"}
    order = F.col(metric).asc() if lower_better else F.col(metric).desc()
    return scores.orderBy(order, F.col(model)).limit(n)


def best_model(scores: DataFrame, metric: str = "R2", model: str = "model") -> DataFrame:
    lower_better = metric.upper() in {"MAE", "MSE", "RMSE", "RMSLE", "MAPE"}
    pick = F.min_by if lower_better else F.max_by
    return scores.agg(pick(F.col(model), F.struct(F.col(metric), F.col(model))).alias("best_model"),
                      (F.min if lower_better else F.max)(metric).alias(f"best_{metric}"))


# M08 -----------------------------------------------------------------------
def blend(cols: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Mean (or weighted mean) of prediction columns."""
    w = list(weights) if weights is not None else [1.0] * len(cols)
    total = float(sum(w))
    return sum([q(c) * (wi / total) for c, wi in zip(cols, w)], F.lit(0.0))


def ensemble(cols: Sequence[str], floor: float | None = None) -> list[Column]:
    """Mean and population std of the model columns (as arrays, one row)."""
    arr = F.array(*[q(c).cast("double") for c in cols])
    if floor is not None:
        arr = F.transform(arr, lambda x: F.greatest(x, F.lit(float(floor))))
    n = F.lit(float(len(cols)))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return [mean.alias("ensemble_mean"), F.sqrt(var).alias("ensemble_std")]


# M14 -----------------------------------------------------------------------
def prediction_stats(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Per model: count, mean, std, min, max, exact median (``approx``: a sketch)."""
    long = df.select(*[known(q(c)).alias(c) for c in cols]).unpivot([], list(cols), "model", "prediction")
    sketch = [F.percentile_approx("prediction", 0.5, 10000).alias("median")] if approx else []
    out = long.groupBy("model").agg(
        F.count("prediction").cast("bigint").alias("count"), F.avg("prediction").alias("mean"),
        F.stddev_samp("prediction").alias("std"), F.min("prediction").alias("min"),
        F.max("prediction").alias("max"), *sketch)
    if approx:
        return out
    return out.join(quantile_table(df, cols, [0.5]).select(F.col("column").alias("model"), F.col("q0").alias("median")), "model", "left")


# M15 -----------------------------------------------------------------------
def prediction_summary(df: DataFrame, cols: Sequence[str], key: str, ratio: float = 0.3) -> DataFrame:
    """Per row: avg, min, max, population std over models; flag std > 30 % of mean."""
    arr = F.array(*[q(c).cast("double") for c in cols])
    n = F.lit(float(len(cols)))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return df.select(q(key), mean.alias("avg"), F.array_min(arr).alias("min"), F.array_max(arr).alias("max"),
                     std.alias("std"), (std > mean * ratio).cast("int").alias("high_variance"))


# M20 -----------------------------------------------------------------------
def compare_importance(imp: DataFrame, n: int = 10, models: Sequence[str] | None = None) -> DataFrame:
    """Pivot feature x model (missing -> 0), mean over models, top n by mean."""
    p = imp.groupBy("feature").pivot("model", list(models) if models else None).agg(F.avg("importance")).na.fill(0.0)
    mcols = [c for c in p.columns if c != "feature"]
    mean = sum([F.col(f"`{c}`") for c in mcols], F.lit(0.0)) / float(len(mcols))
    return p.withColumn("mean_importance", mean).orderBy(F.desc("mean_importance"), "feature").limit(n)


# M23 -----------------------------------------------------------------------
def residuals(df: DataFrame, label: str, pred: str) -> DataFrame:
    e = q(label).cast("double") - q(pred).cast("double")
    return df.select("*", e.alias("residual"), F.abs(e).alias("abs_error"),
                     F.when(q(label) != 0, e / q(label)).alias("relative_error"))


# M18 -----------------------------------------------------------------------
def pick_candidate(df: DataFrame, key: str, candidates: Sequence[float], feature: str, scorer, lo: float = 10,
                   hi: float = 5000) -> DataFrame:
    """Try each candidate for ``feature``, keep predictions in [lo, hi], pick the
    middle kept one (index n // 2 in candidate order). Rows multiply by a fixed
    small list (explode of a literal array), never by a join."""
    arr = F.array(*[F.lit(float(c)) for c in candidates])
    ex = df.select("*", F.posexplode(arr).alias("_pos", "_cand"))
    ex = ex.withColumn(feature, F.col("_cand"))
    scored = scorer.predict(ex, "_pred").where((F.col("_pred") >= lo) & (F.col("_pred") <= hi))
    g = scored.groupBy(q(key)).agg(F.array_sort(F.collect_list(F.struct("_pos", "_cand", "_pred"))).alias("_r"))
    mid = F.element_at("_r", (F.floor(F.size("_r") / 2) + 1).cast("int"))
    return g.select(q(key), mid["_cand"].alias("chosen_value"), mid["_pred"].alias("chosen_prediction"),
                    F.size("_r").alias("n_valid"))


# M27 -----------------------------------------------------------------------
def history_table(hist: DataFrame, ts: str = "timestamp", model: str = "model", hours: str = "prediction_hours") -> DataFrame:
    """The whole history numbered 1..n by time (ties by model, hours, then the other
    columns), with hours and days. Ranges of time are numbered side by side."""
    rest = [c for c in hist.columns if c not in {ts, model, hours}]
    order = [q(c) for c in (ts, model, hours, *rest)]
    rows = materialize(hist.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    n = totals_before(rows, [], "__range", order, F.lit(1), "__before")
    return n.select((F.col("__before") + 1).cast("int").alias("n"), ts, model, hours, (F.col(hours) / 8).alias("days"), *rest)


def history_summary(hist: DataFrame, hours: str = "prediction_hours") -> DataFrame:
    return hist.agg(F.count(F.lit(1)).cast("bigint").alias("total"), F.avg(hours).alias("average"),
                    F.min(hours).alias("min"), F.max(hours).alias("max"),
                    (F.max(hours) - F.min(hours)).alias("range"), F.stddev_pop(hours).alias("std"))


def history_last(hist: DataFrame, n: int = 3, ts: str = "timestamp") -> DataFrame:
    return hist.orderBy(F.desc(ts), *[q(c) for c in hist.columns if c != ts]).limit(n)
