"""Trees fitted on cells: rows with the same feature values, summed before the fit.

A regression tree chooses its splits by sums of (1, y) on either side, so rows that it
can't tell apart may be added up first: a cell is one row with the mean label and the
number of rows as its weight, and the squares inside it drop out of every gain. The
rows are read twice, however many trees, folds and trials are fitted afterwards.

A feature keeps its values while there are about ``VALUES`` of them at most; others are
cut at ``bins`` quantiles, as the tree would cut them itself. So the cells are bounded by
the bins and not by the rows. Boosted trees of squared error are sums of trees on
residuals, whose cell means are the mean label less the prediction: the same holds.
A tree of a random forest sees every row as often as a Poisson draw says; summed with
these draws, a cell is a row again, so a forest is fitted from the bags' sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tabloom.operators.schema import q
from tabloom.session import materialize

#: Specs whose fit needs no more than the cells, and the parameters for which that is so.
CELL_SPECS = ("dt", "gbr")
CELL_PARAMS = {"maxDepth", "maxIter", "stepSize", "minInstancesPerNode", "minInfoGain", "maxBins", "seed"}
VALUES = 100                # distinct values that a feature keeps
_N, _SUM = "_cell_n", "_cell_sum"


def fits_cells(df: DataFrame, features: Sequence[str], spec: str, params: Mapping | None = None) -> bool:
    types = [df.schema[f].dataType for f in features]
    return bool(features) and spec in CELL_SPECS and set(params or {}) <= CELL_PARAMS and all(isinstance(t, (NumericType, BooleanType)) for t in types)


@dataclass
class Binning:
    """How features become the tree's inputs: ``cuts`` holds those that are cut."""
    features: list[str]
    cuts: dict[str, list[float]]

    @property
    def inputs(self) -> list[str]:
        return [f"_bin_{i}" if f in self.cuts else f for i, f in enumerate(self.features)]

    def stages(self) -> list:
        """The stage that puts the inputs beside the features, none if nothing is cut."""
        from pyspark.ml.feature import Bucketizer
        inf = float("inf")
        pairs = [(f, x) for f, x in zip(self.features, self.inputs) if f in self.cuts]
        return [Bucketizer(inputCols=[f for f, _ in pairs], outputCols=[x for _, x in pairs], handleInvalid="keep",
                           splitsArray=[[-inf, *self.cuts[f], inf] for f, _ in pairs])] if pairs else []

    def apply(self, df: DataFrame, keep: Sequence[Column]) -> DataFrame:
        for stage in self.stages():
            df = stage.transform(df)
        values = [q(x).cast("double") for x in self.inputs]
        for i, f in enumerate(self.features):
            if f in self.cuts:             # not finite: left so, and refused by the fit as without bins
                values[i] = F.when(F.abs(q(f).cast("double")) < float("inf"), values[i]).otherwise(float("nan"))
        return df.select(*keep, *[v.alias(x) for v, x in zip(values, self.inputs)])


def fit_binning(df: DataFrame, features: Sequence[str], bins: int = 32) -> Binning:
    xs = {f: q(f).cast("double") for f in features}
    known = {f: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for f, x in xs.items()}
    most = max(VALUES, bins)

    def counts(of: Sequence[str], error: float) -> dict[str, int]:
        return dict(zip(of, df.agg(*[F.approx_count_distinct(xs[f], error).alias(f"n{i}") for i, f in enumerate(of)]).first()))
    found = counts(features, 0.05)                 # the precise estimate costs ten times as much: only if it may be needed
    found.update(counts(near, 0.01) if (near := [f for f in features if most / 2 < found[f] <= most * 2]) else {})
    many = [f for f in features if found[f] > most]
    if not many:
        return Binning(list(features), {})
    probs = [i / bins for i in range(1, bins)]
    at = df.agg(*[F.percentile_approx(known[f], probs, 10000).alias(f"q{i}") for i, f in enumerate(many)]).first()
    return Binning(list(features), {f: sorted(set(at[i])) for i, f in enumerate(many) if at[i]})


def cell_table(df: DataFrame, label: str, binning: Binning, by: Sequence[str] = ()) -> DataFrame:
    """(*by, inputs, rows, label sum) of every cell. A label that is missing makes its cell's
    sum NaN, which the fit refuses as it does the row."""
    y = F.coalesce(q(label).cast("double"), F.lit(float("nan")))
    rows = binning.apply(df, [*[q(c) for c in by], y.alias(_SUM)])
    return rows.groupBy(*by, *[q(x) for x in binning.inputs]).agg(F.count(F.lit(1)).cast("double").alias(_N), F.sum(_SUM).alias(_SUM))


def training_cells(cells: DataFrame, binning: Binning, label: str) -> DataFrame:
    """The cells of a fit: those of all ``by`` taken together, with mean label and weight."""
    both = cells.groupBy(*[q(x) for x in binning.inputs]).agg(F.sum(_N).alias(_N), F.sum(_SUM).alias(_SUM))
    return both.select(*[q(x) for x in binning.inputs], _N, (F.col(_SUM) / F.col(_N)).alias(label))


def fit_tree(train: DataFrame, binning: Binning, label: str, spec: str, params: Mapping | None = None, name: str | None = None,
             binned: bool = False):
    """A scorer of rows (``binned``: of cells) from training cells. The least number of
    rows in a node is a share of the weight here, since a cell stands for many rows."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from tabloom.operators.models import MLScorer, estimator
    params = dict(params or {})
    least = params.pop("minInstancesPerNode", 1)
    if least > 1:
        share = (least - 0.5) / (train.agg(F.sum(_N)).first()[0] or 1.0)
        params.update({"minWeightFractionPerNode": share} if share < 0.5 else {"maxDepth": 0})
    va = VectorAssembler(inputCols=binning.inputs, outputCol="_features", handleInvalid="keep")
    model = Pipeline(stages=[va, estimator(spec, label, params, _N)]).fit(train)
    if not binned:
        model = PipelineModel(stages=[*binning.stages(), *model.stages])
    return MLScorer(name or spec, model, binning.inputs if binned else list(binning.features))


def fit_on_cells(df: DataFrame, label: str, features: Sequence[str], spec: str, params: Mapping | None = None, name: str | None = None):
    binning = fit_binning(df, features, int((params or {}).get("maxBins", 32)))
    return fit_tree(materialize(training_cells(cell_table(df, label, binning), binning, label)), binning, label, spec, params, name)


@dataclass
class FoldCells:
    """The rows of a cross-validation summed by (fold, cell)."""
    df: DataFrame
    label: str
    fold_col: str
    binning: Binning
    cells: DataFrame

    def much_fewer(self, times: int) -> bool:
        """Whether there are fewer cells, all folds together, than a ``times``-th of the rows."""
        n = self.cells.where(F.col(self.fold_col).isNotNull()).groupBy(*[q(x) for x in self.binning.inputs]).agg(F.sum(_N).alias(_N))
        size = n.agg(F.count(F.lit(1)).alias("cells"), F.sum(_N).alias("rows")).first()
        return size["cells"] * times < (size["rows"] or 0)


def fold_cells(df: DataFrame, label: str, features: Sequence[str], bins: int = 32, fold_col: str = "_fold") -> FoldCells:
    binning = fit_binning(df, features, bins)
    return FoldCells(df, label, fold_col, binning, materialize(cell_table(df, label, binning, [fold_col])))


# -- forests
FOREST = {"numTrees": 20, "seed": 123}         # of models.ALGORITHMS


@dataclass
class Forest:
    """The mean of trees, each fitted on its own bag of rows."""
    name: str
    trees: list

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = [f"_tree_{i}" for i in range(len(self.trees))]
        cur = df
        for t, n in zip(self.trees, names):
            cur = t.predict(cur, n)
        return cur.withColumn(out, sum([F.col(n) for n in names], F.lit(0.0)) / float(len(names))).drop(*names)


def bag_table(df: DataFrame, label: str, binning: Binning, key: str | Column, by: Sequence[str], trees: int, seed: int) -> DataFrame:
    """(*by, inputs, n and label sum of every tree's bag, label sum of all rows): each row
    counts as often in a tree's bag as a Poisson(1) draw by its key says. One pass for all."""
    from tabloom.functions.hashing import row_key, unit_uniform
    from tabloom.operators.models import poisson_draw
    k, y = key if isinstance(key, Column) else row_key(df, key), F.coalesce(q(label).cast("double"), F.lit(float("nan")))
    rows = binning.apply(df, [*[q(c) for c in by], y.alias("_y"), *[unit_uniform(k, seed + i).alias(f"_u{i}") for i in range(trees)]])
    draws = [poisson_draw(F.col(f"_u{i}")) for i in range(trees)]          # in the sums, whose code Spark splits: as columns, one method that is not compiled
    sums = [x for i, w in enumerate(draws) for x in (F.sum(w).alias(f"_n{i}"), F.sum(F.when(w > 0, w * F.col("_y")).otherwise(0.0)).alias(f"_s{i}"))]
    return rows.groupBy(*by, *[q(x) for x in binning.inputs]).agg(*sums, F.sum("_y").alias(_SUM))


def fit_bags(df: DataFrame, label: str, features: Sequence[str], key: Column, spec: str, names: Sequence[str], seed: int, threads: int = 4) -> list:
    """A scorer for each of ``names``, fitted on its own bag of rows. As on rows, a cell that
    a bag leaves out stays in it without weight, and a missing label is refused in any cell."""
    from concurrent.futures import ThreadPoolExecutor
    binning = fit_binning(df, features)
    bags = materialize(bag_table(df, label, binning, key, [], len(names), seed))

    def one(i: int):
        n = F.col(f"_n{i}")
        mean = F.when(F.isnan(_SUM), float("nan")).when(n > 0, F.col(f"_s{i}") / n).otherwise(0.0)
        return fit_tree(bags.select(*[q(x) for x in binning.inputs], n.alias(_N), mean.alias(label)), binning, label, spec, name=names[i])
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(one, range(len(names))))


def forest_fits(made: FoldCells, key: str, k: int, pool, name: str = "rf", trees: int = FOREST["numTrees"], seed: int = FOREST["seed"]) -> list[Forest]:
    """A forest for each fold, on the rows of all others, as Spark's grows it (Poisson bags,
    a third of the features at a node), from one pass over the rows."""
    bags = materialize(bag_table(made.df, made.label, made.binning, key, [made.fold_col], trees, seed))
    inputs, sums = [q(x) for x in made.binning.inputs], [f"_{x}{i}" for i in range(trees) for x in "ns"]
    training = list(pool.map(lambda f: materialize(bags.where(F.col(made.fold_col) != f).groupBy(*inputs).agg(*[F.sum(c).alias(c) for c in sums]).coalesce(1)), range(k)))

    def tree(todo: tuple[int, int]):
        f, i = todo
        n = F.col(f"_n{i}")
        bag = training[f].where(n > 0).select(*inputs, n.alias(_N), (F.col(f"_s{i}") / n).alias(made.label))
        return fit_tree(bag, made.binning, made.label, "rf", {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "onethird", "seed": seed + i},
                        f"{name}_{i}", binned=True)
    fits = list(pool.map(tree, [(f, i) for f in range(k) for i in range(trees)]))
    return [Forest(name, fits[f * trees:(f + 1) * trees]) for f in range(k)]


def cross_validate_cells(df: DataFrame, label: str, features: Sequence[str], trials: Mapping[str, tuple[str, Mapping | None]], k: int,
                         fold_col: str = "_fold", threads: int = 4, made: FoldCells | None = None, key: str | None = None) -> DataFrame:
    """Fold scores of any number of trials ({model: (spec, params)}) from two passes over
    the rows for the cells of all folds (``made``, if given) and one for the scores: every
    cell is predicted by the models that have not seen its fold, and each row meets its
    cell's predictions. A forest (rf) takes a pass of its own and needs the rows' ``key``."""
    from concurrent.futures import ThreadPoolExecutor

    from tabloom.operators.metrics import regression_metrics
    from tabloom.operators.models import out_of_fold
    made = made or fold_cells(df, label, features, max([int((p or {}).get("maxBins", 32)) for _, p in trials.values()]), fold_col)
    binning, cells = made.binning, made.cells
    todo = [(m, f) for m in trials for f in range(k) if trials[m][0] != "rf"]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        training = list(pool.map(lambda f: materialize(training_cells(cells.where(F.col(fold_col) != f), binning, label)), range(k))) if todo else []
        fits = list(pool.map(lambda t: fit_tree(training[t[1]], binning, label, *trials[t[0]], name=t[0], binned=True), todo))
        grown = {m: forest_fits(made, key, k, pool, m) for m in trials if trials[m][0] == "rf"}
    names = [f"_pred_{i}" for i in range(len(trials))]
    by_trial = {n: grown.get(m) or [x for x, (of, _) in zip(fits, todo) if of == m] for n, m in zip(names, trials)}
    points = cells.select(fold_col, *[q(x) for x in binning.inputs])
    predicted = materialize(out_of_fold(points, by_trial, k, fold_col).select(
        F.col(fold_col).alias("_at_fold"), *[q(x).alias(f"_at_{i}") for i, x in enumerate(binning.inputs)], *names))
    rows = binning.apply(df, [F.col(fold_col).alias("fold"), q(label).alias("_label")])
    same = F.col("fold") == F.col("_at_fold")
    for i, x in enumerate(binning.inputs):
        same = same & q(x).eqNullSafe(F.col(f"_at_{i}"))
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(n).alias("_pred")) for m, n in zip(trials, names)])
    scored = rows.join(predicted, same).select("fold", "_label", F.inline(each))
    return regression_metrics(scored, "_label", "_pred", ["model", "fold"])
