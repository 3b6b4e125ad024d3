"""Models: fit, compare, tune, ensemble, score and explain.

Two kinds of scorer share one interface, ``predict(df, out) -> df``:
- ``LinearScorer``: coefficients as a column expression (M24 one-pass least
  squares, M26 mean model, literal-coefficient models). Stays in codegen.
- ``MLScorer``: a Spark ML ``PipelineModel`` (VectorAssembler + regressor);
  lr/ridge/lasso/elastic net/huber -> LinearRegression, dt, rf, gbr (GBT);
  dt and gbr are fitted on summed rows (``operators.cells``).

Cross-validation assigns folds by hash (K10), persists only the prepared
training table and fits the models of a comparison from a small driver thread
pool (each fit is itself a distributed job). Nothing collects rows.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32, unit_uniform, row_key
from tabloom.operators.metrics import metric_columns, regression_metrics
from tabloom.operators.schema import q


# ---------------------------------------------------------------------------
# Scorers
# ---------------------------------------------------------------------------
@dataclass
class LinearScorer:
    name: str
    coefs: dict[str, float]
    intercept: float = 0.0
    means: dict[str, float] = field(default_factory=dict)

    def expr(self) -> Column:
        out = F.lit(float(self.intercept))
        for f, c in self.coefs.items():
            out = out + F.coalesce(q(f).cast("double"), F.lit(0.0)) * F.lit(float(c))
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expr())

    def importance(self) -> list[tuple[str, float]]:
        return [(f, abs(c)) for f, c in self.coefs.items()]

    def to_json(self) -> dict:
        return {"kind": "linear", "name": self.name, "coefs": self.coefs, "intercept": self.intercept}


@dataclass
class MLScorer:
    name: str
    model: object            # pyspark.ml.PipelineModel
    features: list[str]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        cols = df.columns
        res = self.model.transform(df)
        return res.select(*[q(c) for c in cols], F.col("_prediction").alias(out))

    def importance(self) -> list[tuple[str, float]]:
        est = self.model.stages[-1]
        if hasattr(est, "featureImportances"):
            vals = est.featureImportances.toArray()
        elif hasattr(est, "coefficients"):
            vals = np.abs(est.coefficients.toArray())
        else:
            vals = np.zeros(len(self.features))
        return list(zip(self.features, [float(v) for v in vals]))

    def to_json(self) -> dict:
        est = self.model.stages[-1]
        params = {p.name: v for p, v in est.extractParamMap().items() if isinstance(v, (int, float, str, bool))}
        return {"kind": "ml", "name": self.name, "algorithm": type(est).__name__, "features": self.features,
                "params": params}


@dataclass
class KnnScorer:
    """Exact k-nearest-neighbour mean of the training labels."""
    name: str
    train: DataFrame
    features: list[str]
    label: str
    key: str
    k: int = 5

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        from tabloom.operators.knn import knn_predict
        cols = df.columns
        res = knn_predict(self.train, df, self.features, self.label, self.key, self.k)
        return res.select(*[q(c) for c in cols], F.col("prediction").alias(out))

    def importance(self) -> list[tuple[str, float]]:
        return [(f, 0.0) for f in self.features]

    def to_json(self) -> dict:
        return {"kind": "knn", "name": self.name, "features": self.features, "k": self.k}


# M26 -----------------------------------------------------------------------
def dummy(df: DataFrame, label: str, name: str = "dummy") -> LinearScorer:
    m = df.agg(F.avg(q(label))).first()[0]
    return LinearScorer(name, {}, float(m))


# M24 -----------------------------------------------------------------------
def ols(df: DataFrame, label: str, features: Sequence[str], l2: float = 0.0, name: str = "ols",
        fit_intercept: bool = True) -> LinearScorer:
    """Least squares / ridge from one pass of X'X and X'y over the rows whose label and
    features are finite; a p x p solve on the driver. Ridge penalises the
    coefficients, not the intercept."""
    from tabloom.operators.correlation import gramian
    xs = ([F.lit(1.0)] if fit_intercept else []) + [q(f) for f in features]
    p = len(xs)
    both, _ = gramian(df, [*xs, q(label)])
    g, b = both[:p, :p], both[:p, p]
    if l2:
        pen = np.eye(p) * l2
        if fit_intercept:
            pen[0, 0] = 0.0
        g = g + pen
    beta = np.linalg.solve(g, b)
    if fit_intercept:
        return LinearScorer(name, dict(zip(features, map(float, beta[1:]))), float(beta[0]))
    return LinearScorer(name, dict(zip(features, map(float, beta))), 0.0)


# M03 / M11 -----------------------------------------------------------------
ALGORITHMS = {
    "lr": ("LinearRegression", {}),
    "ridge": ("LinearRegression", {"regParam": 1.0, "elasticNetParam": 0.0}),
    "lasso": ("LinearRegression", {"regParam": 1.0, "elasticNetParam": 1.0}),
    "en": ("LinearRegression", {"regParam": 1.0, "elasticNetParam": 0.5}),
    "huber": ("LinearRegression", {"loss": "huber"}),
    "dt": ("DecisionTreeRegressor", {"seed": 123}),
    "rf": ("RandomForestRegressor", {"seed": 123, "numTrees": 20}),
    "gbr": ("GBTRegressor", {"seed": 123, "maxIter": 20}),
}


def estimator(spec: str, label: str, params: Mapping | None = None, weight: str | None = None):
    import pyspark.ml.regression as R
    cls_name, defaults = ALGORITHMS[spec]
    kw = dict(defaults)
    kw.update(params or {})
    kw.update(featuresCol="_features", labelCol=label, predictionCol="_prediction")
    if weight:
        kw["weightCol"] = weight
    return getattr(R, cls_name)(**kw)


def fit_model(df: DataFrame, label: str, features: Sequence[str], spec: str, params: Mapping | None = None,
              name: str | None = None, weight: str | None = None):
    """Fit one model on all given rows (``finalize`` = fit on everything)."""
    if spec == "dummy":
        return dummy(df, label, name or spec)
    if spec == "ols":
        return ols(df, label, features, float((params or {}).get("l2", 0.0)), name or spec)
    if spec == "knn":
        p = dict(params or {})
        if "key" not in p:
            raise ValueError("knn needs the name of a key column: params={'key': ...}")
        return KnnScorer(name or spec, df, list(features), label, p["key"], int(p.get("k", 5)))
    from tabloom.operators.cells import fit_on_cells, fits_cells
    if not weight and fits_cells(df, features, spec, params):
        return fit_on_cells(df, label, features, spec, params, name)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    model = Pipeline(stages=[va, estimator(spec, label, params, weight)]).fit(df)
    return MLScorer(name or spec, model, list(features))


finalize = fit_model


# M02 -----------------------------------------------------------------------
def fold_fits(df: DataFrame, label: str, features: Sequence[str], spec: str, k: int, params: Mapping | None = None,
              fold_col: str = "_fold", name: str | None = None) -> list:
    """The spec's k models, each fitted on the rows of all other folds."""
    return [fit_model(df.where(F.col(fold_col) != f), label, features, spec, params, name) for f in range(k)]


def out_of_fold(df: DataFrame, models: Mapping[str, Sequence], k: int, fold_col: str = "_fold") -> DataFrame:
    """Every row with a column for each of ``models`` ({column: its k fold models}): the
    prediction of the model that has not seen the row. The models of a fold are applied
    to its rows one after the other, so nothing is joined."""
    parts = []
    for f in range(k):
        part = df.where(F.col(fold_col) == f)
        for out, fits in models.items():
            part = fits[f].predict(part, out)
        parts.append(part)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def cross_validate(df: DataFrame, label: str, features: Sequence[str], spec: str, k: int = 10,
                   params: Mapping | None = None, fold_col: str = "_fold", name: str | None = None, key: str | None = None) -> DataFrame:
    """Per-fold metrics of one spec, all folds in one aggregate."""
    if spec == "knn" and key:
        params = {**(params or {}), "key": key}
    scored = out_of_fold(df, {"_pred": fold_fits(df, label, features, spec, k, params, fold_col, name)}, k, fold_col)
    scores = regression_metrics(scored.withColumn("fold", F.col(fold_col)), label, "_pred", ["fold"])
    return scores.withColumn("model", F.lit(name or spec))


def prepare_folds(df: DataFrame, key: str, k: int = 10, seed: int = 123, fold_col: str = "_fold") -> DataFrame:
    return df.withColumn(fold_col, F.pmod(mix32(row_key(df, key), seed), F.lit(k)).cast("int"))


def compare_models(df: DataFrame, label: str, features: Sequence[str], key: str, specs: Sequence[str],
                   k: int = 10, sort: str = "R2", n_select: int = 3, seed: int = 123, threads: int = 4
                   ) -> tuple[DataFrame, DataFrame]:
    """(fold scores of all models, mean table sorted by ``sort`` with the top
    ``n_select`` flagged). Folds by hash; the prepared table is persisted once. All
    linear specs together take two passes (``linear_cv``), all trees of summed rows three
    (``cells``) and a forest one more, if the cells are far fewer than the rows; k-NN takes
    three (``knn_folds``); the others are fitted per fold, a few at a time."""
    from tabloom.operators.cells import FOREST, cross_validate_cells, fits_cells, fold_cells
    from tabloom.operators.knn import knn_folds
    from tabloom.operators.linear_cv import LINEAR_SPECS, cross_validate_linear
    data = prepare_folds(df.select(q(key), q(label), *[q(f) for f in features]), key, k, seed).persist()
    linear, trees = [s for s in specs if s in LINEAR_SPECS], [s for s in specs if fits_cells(data, features, s)]
    made = fold_cells(data, label, features) if trees else None
    if made and "rf" in specs and made.much_fewer(2 * FOREST["numTrees"]):            # a cell holds two sums a tree
        trees.append("rf")
    others = [s for s in specs if s not in linear and s not in trees and s != "knn"]

    def from_sums() -> list[DataFrame]:
        return [_materialized(cross_validate_linear(data, label, features, linear, k))] if linear else []

    def from_cells() -> list[DataFrame]:
        return [_materialized(cross_validate_cells(data, label, features, {s: (s, None) for s in trees}, k, threads=threads, made=made, key=key))] if trees else []

    def from_neighbours() -> list[DataFrame]:
        if "knn" not in specs:
            return []
        near = knn_folds(data, features, label, key, "_fold", k, threads=threads)
        return [_materialized(regression_metrics(near, label, "_pred", ["fold"]).withColumn("model", F.lit("knn")))]

    def from_rows() -> list[DataFrame]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            return list(pool.map(lambda s: _materialized(cross_validate(data, label, features, s, k, key=key)), others))
    try:
        with ThreadPoolExecutor() as groups:             # most of their jobs are small: they fill each other's gaps
            started = [groups.submit(g) for g in (from_sums, from_cells, from_neighbours, from_rows)]
            parts = [p for g in started for p in g.result()]
    finally:
        data.unpersist()
    folds = parts[0]
    for p in parts[1:]:
        folds = folds.unionByName(p)
    means = folds.groupBy("model").agg(*[F.avg(m).alias(m) for m in ["MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE"]])
    lower = sort.upper() in {"MAE", "MSE", "RMSE", "RMSLE", "MAPE"}
    ranked = means.orderBy(F.col(sort).asc() if lower else F.col(sort).desc(), "model")
    return folds, ranked.limit(n_select)


def _materialized(df: DataFrame) -> DataFrame:
    """Fold scores are tiny: build them as a local frame so later unions do not
    re-run the fits."""
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema)


# M04 -----------------------------------------------------------------------
def tune(df: DataFrame, label: str, features: Sequence[str], key: str, spec: str, grid: Mapping[str, Sequence],
         n_iter: int = 10, metric: str = "R2", k: int = 5, seed: int = 123, threads: int = 4) -> tuple[dict, DataFrame]:
    """Random search: n_iter parameter maps drawn (seeded) from the grid, each
    scored by k-fold CV, a few at a time (trees on summed rows all at once, ``cells``);
    returns (best params, table of all tried)."""
    from tabloom.operators.cells import cross_validate_cells, fits_cells
    combos = [dict(zip(grid, vals)) for vals in itertools.product(*grid.values())]
    rng = random.Random(seed)
    tried = combos if len(combos) <= n_iter else rng.sample(combos, n_iter)
    folds = prepare_folds(df.select(q(key), q(label), *[q(f) for f in features]), key, k, seed)
    cells = all(fits_cells(df, features, spec, p) for p in tried)
    data = folds if cells else folds.persist()

    def trial(i: int, params: dict) -> tuple:
        s = cross_validate(data, label, features, spec, k, params, name=f"{spec}_{i}")
        r = s.agg(*[F.avg(m).alias(m) for m in ["MAE", "RMSE", "R2"]]).first()
        return i, json.dumps(params, sort_keys=True), r["MAE"], r["RMSE"], r["R2"]
    def from_cells() -> list[tuple]:
        scores = cross_validate_cells(data, label, features, {str(i): (spec, p) for i, p in enumerate(tried)}, k, threads=threads)
        found = {r["model"]: r for r in scores.groupBy("model").agg(*[F.avg(m).alias(m) for m in ["MAE", "RMSE", "R2"]]).collect()}
        none = dict.fromkeys(["MAE", "RMSE", "R2"])
        return [(i, json.dumps(p, sort_keys=True), *[found.get(str(i), none)[m] for m in none]) for i, p in enumerate(tried)]
    try:
        if cells:
            rows = from_cells()
        else:
            with ThreadPoolExecutor(max_workers=threads) as pool:
                rows = list(pool.map(trial, range(len(tried)), tried))
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame(rows, "trial int, params string, MAE double, RMSE double, R2 double")
    lower = metric.upper() in {"MAE", "RMSE"}
    best = (min if lower else max)(rows, key=lambda r: r[{"MAE": 2, "RMSE": 3, "R2": 4}[metric.upper()]])
    return json.loads(best[1]), table


# M09 -----------------------------------------------------------------------
def stack(df: DataFrame, label: str, features: Sequence[str], key: str, specs: Sequence[str], k: int = 5,
          seed: int = 123) -> tuple[list, LinearScorer]:
    """Meta linear model on out-of-fold predictions of the base models; base
    models are then refitted on all rows."""
    data = prepare_folds(df.select(q(key), q(label), *[q(f) for f in features]), key, k, seed).persist()
    try:
        oof = out_of_fold(data, {f"pred_{s}": fold_fits(data, label, features, s, k) for s in specs}, k)
        meta = ols(oof, label, [f"pred_{s}" for s in specs], name="stack_meta")
        bases = [fit_model(data, label, features, s) for s in specs]
    finally:
        data.unpersist()
    return bases, meta


def stack_predict(df: DataFrame, bases, meta: LinearScorer, out: str = "prediction") -> DataFrame:
    cur = df
    for b in bases:
        cur = b.predict(cur, f"pred_{b.name}")
    return meta.predict(cur, out)


# M10 -----------------------------------------------------------------------
def poisson_weight(key: Column, seed: int) -> Column:
    """Bootstrap weight ~ Poisson(1) from a hashed uniform (inverse CDF)."""
    return poisson_draw(unit_uniform(key, seed))


def poisson_draw(u: Column) -> Column:
    """Poisson(1) of a uniform number, best a column: it is compared up to ten times."""
    import math
    cdf, acc, term = [], 0.0, math.exp(-1)
    for i in range(10):
        acc += term
        cdf.append(acc)
        term = term / (i + 1)
    w = F.lit(10.0)
    for i in reversed(range(10)):
        w = F.when(u <= cdf[i], F.lit(float(i))).otherwise(w)
    return w


def bag(df: DataFrame, label: str, features: Sequence[str], key: str, spec: str, n: int = 10,
        seed: int = 123) -> list:
    """n models on hashed Poisson(1) bootstrap weights (``weightCol``). The source is read
    for one table with the weights of all bags: summed by cell, if the spec needs no more
    (``cells``), else row by row and persisted."""
    from tabloom.operators.cells import fit_bags, fits_cells
    names = [f"{spec}_bag{i}" for i in range(n)]
    if fits_cells(df, features, spec):
        return fit_bags(df, label, features, q(key), spec, names, seed)
    weighted = df.select(q(label), *[q(f) for f in features], *[poisson_weight(q(key), seed + i).alias(f"_w{i}") for i in range(n)]).persist()
    try:
        return [fit_model(weighted, label, features, spec, name=names[i], weight=f"_w{i}") for i in range(n)]
    finally:
        weighted.unpersist()


def _stage_params(stage) -> tuple:
    return type(stage), {p.name: v for p, v in stage.extractParamMap().items()}


def _alike_but_last(models: Sequence) -> bool:
    """Whether the scorers are pipelines that make the same vector for their last stage."""
    if not models or not all(isinstance(m, MLScorer) and hasattr(m.model.stages[-1], "predictionCol") for m in models):
        return False
    first, *others = [[_stage_params(s) for s in m.model.stages[:-1]] for m in models]
    return all(o == first for o in others)


def bag_predict(df: DataFrame, models: Sequence, out: str = "prediction") -> DataFrame:
    """The mean prediction of the models. The vector that they all read is made once a row."""
    cur = df
    cols = [f"_p_{m.name}" for m in models]
    if _alike_but_last(models):
        for stage in models[0].model.stages[:-1]:
            cur = stage.transform(cur)
        for m, c in zip(models, cols):
            last = m.model.stages[-1]
            cur = last.transform(cur, {last.predictionCol: c})
        cur = cur.select(*[q(c) for c in df.columns], *[q(c) for c in cols])
    else:
        for m, c in zip(models, cols):
            cur = m.predict(cur, c)
    return cur.withColumn(out, sum([F.col(c) for c in cols], F.lit(0.0)) / float(len(cols))).drop(*cols)


# M12 / M28 -------------------------------------------------------------------
def save_model(scorer, path: str, rank: int | None = None, metrics: Mapping | None = None) -> None:
    """Model (Spark ML writer) and its metadata record (one JSON line)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = scorer.to_json()
    meta.update({"rank": rank, "metrics": dict(metrics or {})})
    if isinstance(scorer, MLScorer):
        scorer.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str):
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta["kind"] == "linear":
        return LinearScorer(meta["name"], meta["coefs"], meta["intercept"])
    return MLScorer(meta["name"], PipelineModel.load(f"{path}/model"), meta["features"])


def model_registry(spark, paths: Sequence[str]) -> DataFrame:
    return spark.read.json([f"{p}/metadata" for p in paths])


def registry_check(registry: DataFrame, expected_features: Sequence[str]) -> DataFrame:
    """(name, status, n_features, n_expected): status ok / missing_features."""
    exp = F.array(*[F.lit(f) for f in expected_features])
    feats = F.coalesce(F.col("features"), F.array().cast("array<string>"))
    missing = F.size(F.array_except(exp, feats))
    return registry.select("name", F.when(missing == 0, "ok").otherwise("missing_features").alias("status"),
                           F.size(feats).alias("n_features"), F.lit(len(expected_features)).alias("n_expected"))


def model_files(spark, paths: Sequence[str]) -> DataFrame:
    """(path, files, bytes, modified) of saved models, from the file listing alone (the
    ``binaryFile`` source without its content, through Hadoop's file system)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    where = F.coalesce(*[F.when(F.contains("path", F.lit(f"{p.split(':', 1)[-1].rstrip('/')}/")), F.lit(p)) for p in paths])
    return (listed.groupBy(where.alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                                                    F.max("modificationTime").alias("modified")))


def check_models(spark, paths: Sequence[str], expected_features: Sequence[str]) -> DataFrame:
    """A row a saved model: (path, name, status, loaded, n_features, n_expected, files,
    bytes, modified). Status: ok, missing_features, or unreadable if it can't be loaded."""
    rows = []
    for p in paths:
        try:
            model = load_model(p)
            have = list(model.coefs) if isinstance(model, LinearScorer) else list(model.features)
            rows.append((p, model.name, "ok" if set(expected_features) <= set(have) else "missing_features", True, len(have)))
        except Exception:                                            # whatever keeps it from being used is the finding
            rows.append((p, None, "unreadable", False, None))
    found = spark.createDataFrame(rows, "path string, name string, status string, loaded boolean, n_features int")
    return (found.withColumn("n_expected", F.lit(len(expected_features))).join(model_files(spark, paths), "path", "left"))


def model_summary(checked: DataFrame) -> DataFrame:
    """(status, models, loaded, bytes) of a model check."""
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("models"), F.count_if("loaded").alias("loaded"), F.sum("bytes").alias("bytes"))


# M13 -----------------------------------------------------------------------
def score_all(df: DataFrame, scorers: Sequence, floor: float | None = 0.1) -> DataFrame:
    """One column per model (floored), then ensemble mean and population std."""
    from tabloom.operators.metrics import ensemble
    cur = df
    for s in scorers:
        cur = s.predict(cur, f"pred_{s.name}")
        if floor is not None:
            cur = cur.withColumn(f"pred_{s.name}", F.greatest(F.col(f"pred_{s.name}"), F.lit(float(floor))))
    return cur.select("*", *ensemble([f"pred_{s.name}" for s in scorers]))


def scores_side_by_side(df: DataFrame, scorers: Sequence, label: str) -> dict:
    """{name: its ``regression_metrics`` row} of all scorers, from one pass over the rows."""
    cur = df
    for i, s in enumerate(scorers):
        cur = s.predict(cur, f"_p{i}")
    each = F.array(*[F.struct(F.lit(i).alias("_model"), F.col(f"_p{i}").alias("_p")) for i in range(len(scorers))])
    rows = regression_metrics(cur.select(q(label), F.inline(each)), label, "_p", ["_model"]).collect()
    found = {scorers[r["_model"]].name: r for r in rows}
    none = dict.fromkeys(["n", "MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE"])            # no rows: no scores
    return {s.name: found.get(s.name, none) for s in scorers}


# M16 / M17 -------------------------------------------------------------------
def what_if(df: DataFrame, param: str, values: Sequence[float], scorer, out: str = "prediction") -> DataFrame:
    """Vary ``param`` over a fixed list for every base row: rows multiply by the
    list through ``explode`` of a literal array (no join), one scoring pass."""
    arr = F.array(*[F.lit(float(v)) for v in values])
    ex = df.select("*", F.posexplode(arr).alias("step", "_v")).withColumn(param, F.col("_v")).drop("_v")
    return scorer.predict(ex, out)


def what_if_grid(df: DataFrame, param: str, cfg_min: float, cfg_max: float, n: int = 15,
                 min_share: float = 0.1) -> DataFrame:
    """Adds ``lo``, ``hi``, ``range_type`` and explodes ``n`` even points
    (``step``, ``value``): half to double the current value inside the
    configured bounds, or the whole configured range when that is too narrow."""
    c = q(param).cast("double")
    dmin = F.greatest(F.lit(float(cfg_min)), c * 0.5)
    dmax = F.least(F.lit(float(cfg_max)), c * 2.0)
    narrow = c.isNull() | ((dmax - dmin) < (cfg_max - cfg_min) * min_share)
    lo = F.when(narrow, F.lit(float(cfg_min))).otherwise(dmin)
    hi = F.when(narrow, F.lit(float(cfg_max))).otherwise(dmax)
    kind = F.when(c.isNull(), "config").when(narrow, "config_fallback").otherwise("dynamic")
    base = df.select("*", c.alias("current"), lo.alias("lo"), hi.alias("hi"), kind.alias("range_type"))
    ex = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    value = F.when(F.col("step") == n - 1, F.col("hi")).otherwise(
        F.col("lo") + F.col("step") * ((F.col("hi") - F.col("lo")) / (n - 1)))
    return ex.withColumn("value", value)


def what_if_summary(scored: DataFrame, key: str, current_pred: str = "current_prediction") -> DataFrame:
    """Per base row: prediction range, impact, sensitivity per unit."""
    g = scored.groupBy(q(key)).agg(F.min("prediction").alias("min_prediction"),
                                   F.max("prediction").alias("max_prediction"),
                                   F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    impact = F.greatest(F.col("max_prediction") - F.col("min_prediction"), F.lit(0.0))
    return g.select(q(key), "min_prediction", "max_prediction", impact.alias("impact"),
                    F.when(impact > 0, impact / (F.col("hi") - F.col("lo"))).alias("sensitivity"))


# M19 / M20 -------------------------------------------------------------------
def importance(spark, scorers: Sequence) -> DataFrame:
    """(model, feature, importance, rank) for each model (rank 1 = largest)."""
    rows = []
    for s in scorers:
        imp = sorted(s.importance(), key=lambda t: (-t[1], t[0]))
        rows += [(s.name, f, float(v), i + 1) for i, (f, v) in enumerate(imp)]
    return spark.createDataFrame(rows, "model string, feature string, importance double, rank int")


# M21 -----------------------------------------------------------------------
ROWS_PER_BUCKET = 100_000          # rows ordered by one task of a permutation
HELD = 5                           # as many times that number of rows a task holds as one array; more are sorted on disk


def paired_repeats(df: DataFrame, cols: Sequence[str], key: str, seeds: Sequence[int]) -> DataFrame:
    """Every row once a seed, with its place among the seeds as ``_repeat`` and ``cols`` of
    another row beside it as ``_perm_<col>``. Rows fall into hash buckets (as many as the
    row count asks for) by the only shuffle; in a bucket, for each seed, the row ranked r
    by one hash order meets the row ranked r by another. No global sort.

    A bucket is sorted by key once and held as an array. A hash order of it is a sorted
    array of longs, the hash above and the row's place below, so no repeat moves rows.
    If a key held by very many rows makes a bucket too large for that, windows rank the rows."""
    buckets = max(1, df.count() // ROWS_PER_BUCKET)
    k = row_key(df, key)
    placed = df.where(k.isNotNull()).withColumn("_b", F.pmod(mix32(k, seeds[0] * 7919 + 1), F.lit(buckets)))
    largest = placed.groupBy("_b").count().agg(F.max("count")).first()[0] or 0
    placed = placed.repartition(buckets, "_b")
    if largest > HELD * ROWS_PER_BUCKET:
        return _paired_by_windows(placed, k, cols, key, seeds)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))               # in the partition
    placed = placed.sortWithinPartitions("_b", q(key)).select("*", F.coalesce(k, F.lit(0)).alias("_k"), place.alias("_at"))
    orders = [F.shiftleft(mix32("_k", s + x), 31).bitwiseOR(F.col("_at")).alias(f"_{i}_{x}") for i, s in enumerate(seeds) for x in (0, 100003)]
    rows = placed.select("_b", "_at", F.struct(*[q(c) for c in df.columns]).alias("_row"), F.struct(*orders).alias("_order"))
    held = rows.groupBy("_b").agg(F.min("_at").alias("_first"), F.collect_list("_row").alias("_rows"), F.collect_list("_order").alias("_orders"))
    turns = [F.struct(F.lit(i).alias("_repeat"), *[F.sort_array(F.col("_orders")[f"_{i}_{x}"]).alias(n) for x, n in ((0, "_own"), (100003, "_other"))])
             for i in range(len(seeds))]
    ranks = held.select("_first", "_rows", F.inline(F.array(*turns))).select("_first", "_rows", "_repeat", "_other", F.posexplode("_own").alias("_r", "_own"))

    def at(ranked: Column) -> Column:
        return F.get("_rows", (ranked.bitwiseAND(F.lit(2**31 - 1)) - F.col("_first")).cast("int"))
    own, other = at(F.col("_own")), at(F.get("_other", F.col("_r")))
    return ranks.select(*[own[c].alias(c) for c in df.columns], "_repeat", *[other[c].alias(f"_perm_{c}") for c in cols])


def _paired_by_windows(placed: DataFrame, k: Column, cols: Sequence[str], key: str, seeds: Sequence[int]) -> DataFrame:
    """``paired_repeats`` of placed rows: a row comes once a seed and order, is ranked, and
    those of one rank stand next to each other. Repeats are sorted, on disk if need be."""
    turns = [F.struct(F.lit(i).alias("_repeat"), F.lit(taken).alias("_taken"), mix32(k, s + (100003 if taken else 0)).alias("_h"))
             for i, s in enumerate(seeds) for taken in (False, True)]
    one_order = Window.partitionBy("_b", "_repeat", "_taken").orderBy("_h", q(key))
    rows = placed.select("*", F.inline(F.array(*turns))).withColumn("_r", F.row_number().over(one_order))
    by_rank = Window.partitionBy("_b", "_repeat").orderBy("_r", "_taken")
    met = [F.lead(q(c)).over(by_rank).alias(f"_perm_{c}") for c in cols]
    return rows.select("*", *met).where(~F.col("_taken")).drop("_b", "_taken", "_h", "_r")


def paired_rows(df: DataFrame, cols: Sequence[str], key: str, seed: int) -> DataFrame:
    """Every row with ``cols`` of another row beside it, as ``_perm_<col>`` (``paired_repeats``)."""
    return paired_repeats(df, cols, key, [seed]).drop("_repeat")


def permute_column(df: DataFrame, col: str, key: str, seed: int) -> DataFrame:
    """``col`` shuffled across rows, within hash buckets."""
    return paired_rows(df, [col], key, seed).withColumn(col, q(f"_perm_{col}")).drop(f"_perm_{col}")


def permutation_importance(df: DataFrame, scorer, label: str, features: Sequence[str], key: str, n: int = 10,
                           metric: str = "R2", seed: int = 0) -> DataFrame:
    """(feature, mean_drop, std_drop): metric drop when one feature is shuffled, n repeats.
    The rows are shuffled once; all repeats pair them inside their buckets and score all
    features' shuffles side by side, by the one metric."""
    base = regression_metrics(scorer.predict(df, "_p"), label, "_p").select(metric).first()[metric]
    cur = paired_repeats(df, features, key, range(seed, seed + n))
    for i, f in enumerate(features):
        cur = scorer.predict(cur.withColumn("_own", q(f)).withColumn(f, q(f"_perm_{f}")), f"_p{i}")
        cur = cur.withColumn(f, q("_own")).drop("_own")
    scores = cur.groupBy("_repeat").agg(*[metric_columns(label, f"_p{i}")[metric].alias(f"_m{i}") for i in range(len(features))])
    repeats = scores.orderBy("_repeat").collect()
    drops = {f: [base - r[f"_m{i}"] for r in repeats] for i, f in enumerate(features)}
    rows = [(f, float(np.mean(d)), float(np.std(d))) for f, d in drops.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, mean_drop double, std_drop double")


# M22 -----------------------------------------------------------------------
def linear_attribution(df: DataFrame, scorer: LinearScorer, key: str, means: Mapping[str, float] | None = None
                       ) -> DataFrame:
    """(key, feature, value) with value = coef * (x - mean(x)); the values of a
    row sum to prediction - mean prediction."""
    if means is None:
        row = df.agg(*[F.avg(q(f)).alias(f) for f in scorer.coefs]).first()
        means = {f: float(row[f]) for f in scorer.coefs}
    cols = [(F.coalesce(q(f).cast("double"), F.lit(0.0)) - F.lit(means[f])) * F.lit(float(c))
            for f, c in scorer.coefs.items()]
    names = list(scorer.coefs)
    wide = df.select(q(key), *[c.alias(n) for c, n in zip(cols, names)])
    return wide.unpivot([key], names, "feature", "value")


def attribution_breakdown(df: DataFrame, scorer: LinearScorer, key: str, value) -> DataFrame:
    """(feature, input, value) of one row, besides its mean prediction as feature
    "(mean)": the values add up to the row's prediction."""
    row = df.agg(*[F.avg(q(f)).alias(f) for f in scorer.coefs]).first()
    means = {f: float(row[f]) for f in scorer.coefs}
    one = df.where(q(key) == F.lit(value))
    start = scorer.intercept + sum(c * means[f] for f, c in scorer.coefs.items())
    parts = [F.struct(F.lit("(mean)").alias("feature"), F.lit(None).cast("double").alias("input"), F.lit(float(start)).alias("value"))]
    for f, c in scorer.coefs.items():
        x = F.coalesce(q(f).cast("double"), F.lit(0.0))
        parts.append(F.struct(F.lit(f).alias("feature"), x.alias("input"), ((x - F.lit(means[f])) * F.lit(float(c))).alias("value")))
    return one.select(F.inline(F.array(*parts)))


def dependence_pairs(df: DataFrame, scorer: LinearScorer, key: str, top: int = 2) -> DataFrame:
    """(key, feature, input, value) of the ``top`` features by mean absolute attribution:
    the points of their dependence plots."""
    row = df.agg(*[F.avg(q(f)).alias(f) for f in scorer.coefs]).first()
    means = {f: float(row[f]) for f in scorer.coefs}
    ranking = attribution_ranking(linear_attribution(df, scorer, key, means))
    best = [r["feature"] for r in ranking.orderBy(F.desc("mean_abs"), "feature").limit(top).collect()]
    points = [F.struct(F.lit(f).alias("feature"), q(f).cast("double").alias("input"),
                       ((F.coalesce(q(f).cast("double"), F.lit(0.0)) - F.lit(means[f])) * F.lit(float(scorer.coefs[f]))).alias("value"))
              for f in best]
    return df.select(q(key), F.inline(F.array(*points)))


def attribution_ranking(attr: DataFrame) -> DataFrame:
    return attr.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
