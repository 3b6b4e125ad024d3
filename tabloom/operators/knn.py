"""Exact k-nearest-neighbour mean prediction without all pairs.

Euclidean distance on the given feature columns; ties broken by the training
key (ascending). Steps, all DataFrame jobs:

1. Duplicates are compressed on both sides. Training rows are grouped by
   their coordinates, keeping only the k members with the smallest keys
   (two-level ranking inside salted buckets, so a coordinate held by a third
   of all rows is ranked in pieces); test rows are reduced to their distinct
   coordinates and joined back at the end.
2. Cells: every axis is cut into ``G`` runs of equally many distinct training
   coordinates (G^d about n_unique / per_cell), so cells follow the data's
   density. The borders are a written table (axis, cell, from), numbered by
   distributed running totals; the distinct values of an axis learn their cell
   by an as-of join, the points by an equi-join on the value. Neither borders
   nor values reach the driver, which learns the number of cells of each axis.
3. Ring search per distinct test coordinate: candidate training coordinates
   come from the (2r+1)^d cells around its cell (an equi-join on cell ids, no
   cross product), the k nearest members are ranked, and the result is
   accepted when the k-th distance is below the distance from the point to
   the edge of the searched box - then no unsearched point can be as close.
   Unresolved points retry with a doubled ring; the search ends at the whole
   grid, where every point is resolved.

Training rows with a null label or a feature that is null, NaN or infinite take
no part; test rows with such a feature get a null prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32
from tabloom.operators.asof import last_at_or_before
from tabloom.operators.running import totals_before
from tabloom.operators.schema import q
from tabloom.session import materialize


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _by_axis(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """(axis, x): each coordinate of each point."""
    pairs = F.array(*[F.struct(F.lit(j).alias("axis"), F.col(c).alias("x")) for j, c in enumerate(coords)])
    return points.select(F.inline(pairs))


def _in_blocks(table: DataFrame, *by: str) -> DataFrame:
    """The rows range-partitioned and written, with the number of their range as _block."""
    return materialize(table.repartitionByRange(*by).withColumn("_block", F.spark_partition_id()))


def axis_borders(points: DataFrame, coords: Sequence[str], per_axis: int) -> DataFrame:
    """(axis, cell, from): consecutive cells of each axis, numbered from 0, that hold about
    equally many of the points; a value held by many of them is never split."""
    counted = _in_blocks(_by_axis(points, coords).groupBy("axis", "x").agg(F.count(F.lit(1)).alias("n")), "axis", "x")
    placed = totals_before(counted, ["axis"], "_block", [F.col("x")], F.col("n"), "before", "of")
    runs = (placed.groupBy("axis", F.floor(F.col("before") * F.lit(per_axis) / F.col("of")).alias("run"))
            .agg(F.min("x").alias("from")))
    numbered = totals_before(_in_blocks(runs, "axis", "run"), ["axis"], "_block", [F.col("run")], F.lit(1), "cell")
    return materialize(numbered.select("axis", F.col("cell").cast("long").alias("cell"), "from"))


def _with_cells(points: DataFrame, coords: Sequence[str], cells: DataFrame, prefix: str) -> DataFrame:
    """The points with the cell number of each axis, from the (axis, x, cell) table."""
    for j, c in enumerate(coords):
        of_axis = cells.where(F.col("axis") == j).select(F.col("x").alias(c), F.col("cell").alias(f"{prefix}{j}"))
        points = points.join(of_axis, c)
    return points


def _margin(pending: DataFrame, borders: DataFrame, ncell: Sequence[int], r: int) -> DataFrame:
    """``pending`` with _margin: the distance to the nearest edge of the box of cells
    within r of its own; infinite where the box ends with the grid."""
    sides = []
    for j in range(len(ncell)):
        for side, shift in (("lo", -r), ("hi", r + 1)):
            edge = borders.where(F.col("axis") == j).select((F.col("cell") - shift).alias(f"_t{j}"), F.col("from").alias(f"_{side}{j}"))
            if side == "lo":
                edge = edge.where(F.col(f"_t{j}") > r)          # below cell 0 there is nothing to search
            pending = pending.join(edge, f"_t{j}", "left")
        sides += [F.col(f"_q{j}") - F.col(f"_lo{j}"), F.col(f"_hi{j}") - F.col(f"_q{j}")]
    return pending.withColumn("_margin", F.coalesce(F.least(*sides), F.lit(float("inf")))).drop(
        *[f"_{s}{j}" for j in range(len(ncell)) for s in ("lo", "hi")])


def knn_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str,
                k: int = 5, per_cell: int = 16, salt: int = 32) -> DataFrame:
    """(test rows..., prediction): mean label of the k nearest training rows."""
    feats = list(features)
    d = len(feats)
    xs = [q(f).cast("double") for f in feats]
    coords, qk, tk = ([f"{p}{j}" for j in range(d)] for p in ("_x", "_q", "_t"))
    usable = xs[0].isNotNull()
    for x in xs:
        usable = usable & _finite(x)
    # 1. compressed training coordinates with up to k members (smallest keys)
    tr = train.where(usable & q(label).isNotNull()).select(
        q(key).alias("_k"), *[x.alias(c) for x, c in zip(xs, coords)], q(label).cast("double").alias("_y"))
    b = tr.withColumn("_b", F.pmod(mix32(F.col("_k"), 17), F.lit(salt)))
    w1 = Window.partitionBy(*coords, "_b").orderBy("_k")
    w2 = Window.partitionBy(*coords).orderBy("_k")
    top = (b.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
           .withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k))
    uniq = top.groupBy(*coords).agg(F.collect_list(F.struct("_k", "_y")).alias("_m"))
    uniq = materialize(uniq)
    n_unique = uniq.count()
    if not n_unique:
        raise ValueError("empty training set")
    # 2. borders of the axes, cells of the distinct coordinates of both sides
    g = max(1, int(round((n_unique / per_cell) ** (1.0 / d))))
    te = materialize(test.where(usable).select(*[x.alias(c) for x, c in zip(xs, coords)]).distinct())
    borders = axis_borders(uniq, coords, g)
    known = {r["axis"]: r["n"] for r in borders.groupBy("axis").agg(F.count(F.lit(1)).alias("n")).collect()}
    ncell = [known[j] for j in range(d)]
    values = _by_axis(uniq, coords).unionByName(_by_axis(te, coords)).distinct()
    cells = materialize(last_at_or_before(values, borders.withColumnRenamed("from", "x"), ["axis"], "x")
                        .select("axis", "x", F.coalesce("cell", F.lit(0).cast("long")).alias("cell")))
    tr_cells = materialize(_with_cells(uniq, coords, cells, "_c"))
    pending = materialize(_with_cells(te, coords, cells, "_t").select(*[F.col(c).alias(n) for c, n in zip(coords, qk)], *tk))
    # 3. rings
    done = None
    r = 1
    while True:                        # the ring doubles until nothing is pending; the whole grid resolves all
        full = all(r >= n - 1 for n in ncell)
        probe = _margin(pending, borders, ncell, r)
        for j, n in enumerate(ncell):
            ring = F.sequence(F.greatest(F.col(f"_t{j}") - r, F.lit(0)), F.least(F.col(f"_t{j}") + r, F.lit(n - 1)))
            probe = probe.withColumn(f"_c{j}", F.explode(ring))
        dist = F.sqrt(sum([(F.col(x) - F.col(p)) * (F.col(x) - F.col(p)) for x, p in zip(coords, qk)], F.lit(0.0)))
        mem = probe.join(tr_cells, [f"_c{j}" for j in range(d)]).select(*qk, "_margin", dist.alias("_d"), F.inline("_m"))
        mem = mem.withColumn("_b", F.pmod(mix32(F.col("_k"), 29), F.lit(salt)))
        v1 = Window.partitionBy(*qk, "_b").orderBy("_d", "_k")
        v2 = Window.partitionBy(*qk).orderBy("_d", "_k")
        best = (mem.withColumn("_r", F.row_number().over(v1)).where(F.col("_r") <= k)
                .withColumn("_r", F.row_number().over(v2)).where(F.col("_r") <= k))
        agg = best.groupBy(*qk).agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_kd"),
                                    F.first("_margin").alias("_margin"), F.avg("_y").alias("prediction"))
        ok = F.lit(True) if full else ((F.col("_n") >= k) & (F.col("_kd") < F.col("_margin")))
        res = materialize(agg.where(ok).select(*qk, "prediction"))
        done = res if done is None else done.unionByName(res)
        if full:
            break
        pending = materialize(pending.join(res, qk, "left_anti"))
        if pending.isEmpty():
            break
        r *= 2
    out = test.select("*", *[x.alias(p) for x, p in zip(xs, qk)])
    return out.join(done, qk, "left").drop(*qk)


def knn_folds(df: DataFrame, features: Sequence[str], label: str, key: str, fold_col: str, n_folds: int, k: int = 5, threads: int = 4) -> DataFrame:
    """(fold, <label>, _pred): every row of folds 0 to ``n_folds`` - 1 with the prediction
    of ``knn_predict`` from the rows of all other folds."""
    from concurrent.futures import ThreadPoolExecutor
    coords = [f"_f{j}" for j in range(len(features))]
    rows = df.select(F.col(fold_col).alias("fold"), q(label), q(key).alias("_key"), *[q(f).cast("double").alias(c) for f, c in zip(features, coords)])
    usable = F.lit(True)
    for c in coords:
        usable = usable & _finite(F.col(c))
    smallest = Window.partitionBy("fold", *coords).orderBy("_key")            # limited in every task before the shuffle
    kept = materialize(rows.where(usable & q(label).isNotNull()).withColumn("_r", F.row_number().over(smallest))
                       .where(F.col("_r") <= k).select("fold", "_key", *coords, q(label).cast("double").alias("_y")))
    asked = materialize(rows.where(usable).select("fold", *coords).distinct())

    def one(f: int) -> DataFrame:
        found = knn_predict(kept.where(F.col("fold") != f), asked.where(F.col("fold") == f), coords, "_y", "_key", k)
        return materialize(found.select(F.col("fold").alias("_at_fold"), *[F.col(c).alias(f"_at{c}") for c in coords], F.col("prediction").alias("_pred")))
    with ThreadPoolExecutor(max_workers=threads) as pool:
        parts = list(pool.map(one, range(n_folds)))
    predicted = parts[0]
    for p in parts[1:]:
        predicted = predicted.unionByName(p)
    same = F.col("fold") == F.col("_at_fold")
    for c in coords:
        same = same & (F.col(c) == F.col(f"_at{c}"))
    return rows.where(F.col("fold").between(0, n_folds - 1)).join(predicted, same, "left").select("fold", q(label), "_pred")
