"""Synthetic tables and their similarity to real ones.

Gaussian copula, Spark-first:
- fit (L01): one table of counted values gives every numeric column's exact quantile
  grid (``grid_points`` of them) and, for categorical columns of any cardinality, a
  written table (column, value, lo, hi) of the levels' cumulative shares. Rows are
  mapped to normal scores through these marginals, categories by a join on their
  value. Only the grids and the p x p matrix reach the driver.
- sample (L02): ``spark.range(n)``; independent normals from hashed uniforms
  (deterministic by seed, no ``rand()``), correlated by the Cholesky factor as
  column sums, mapped back through the marginals: grids are column expressions,
  categories a join of the uniform's slot with the levels whose shares touch it.
The normal CDF and its inverse are closed-form approximations (Abramowitz &
Stegun 26.2.17 / 26.2.23, with one Newton step on the inverse).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tabloom.functions.hashing import row_key, unit_uniform
from tabloom.operators.correlation import correlations
from tabloom.operators.counted import counted_values
from tabloom.operators.schema import q
from tabloom.session import materialize


SLOTS = 65536                      # parts of (0, 1) by which levels are looked up, at most

# ---------------------------------------------------------------------------
# Normal CDF / inverse as column expressions
# ---------------------------------------------------------------------------
def norm_cdf(x: Column) -> Column:
    """Phi(x), |error| < 7.5e-8 (A&S 26.2.17)."""
    p, b = 0.2316419, [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + ax * p)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = F.exp(-ax * ax / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def norm_ppf(u: Column) -> Column:
    """Phi^-1(u) for u in (0, 1): A&S 26.2.23 then one Newton step."""
    c, d = [2.515517, 0.802853, 0.010328], [1.432788, 0.189269, 0.001308]
    pu = F.when(u < 0.5, u).otherwise(F.lit(1.0) - u)
    t = F.sqrt(-2.0 * F.log(pu))
    z = t - (c[0] + t * (c[1] + t * c[2])) / (F.lit(1.0) + t * (d[0] + t * (d[1] + t * d[2])))
    z = F.when(u < 0.5, -z).otherwise(z)
    pdf = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return z - (norm_cdf(z) - u) / pdf


# ---------------------------------------------------------------------------
@dataclass
class Copula:
    numeric: dict[str, list[float]]                   # column -> quantile grid (ascending)
    categorical: list[str]
    levels: DataFrame | None                          # (column, value, lo, hi): cumulative shares
    columns: list[str]
    corr: list[list[float]]
    kinds: dict[str, str]

    # -- marginal maps (staged: every step names its result, so expression
    #    trees never nest a previous step more than once) ----------------------
    def _arr(self, vals):
        return F.array(*[F.lit(float(v)) for v in vals])

    def scores(self, df: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """Normal scores of each row (ties of categories spread by hash); null for a
        missing value or a category that the fit has not seen."""
        cur = df.select(row_key(df, key).alias("_key"), *[q(c).alias(f"_x{j}") for j, c in enumerate(self.columns)])
        for j, c in enumerate(self.columns):
            if c in self.categorical:
                shares = self.levels.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("lo").alias(f"_lo{j}"), F.col("hi").alias(f"_hi{j}"))
                cur = cur.join(shares, F.col(f"_x{j}").cast("string") == F.col("_value"), "left").drop("_value")
        stage = []
        for j, c in enumerate(self.columns):
            if c in self.numeric:
                k = len(self.numeric[c]) - 1
                arr, x = self._arr(self.numeric[c]), F.col(f"_x{j}").cast("double")
                stage.append(F.greatest(F.least(F.size(F.filter(arr, lambda v: v <= x)) - 1, F.lit(k - 1)), F.lit(0)).alias(f"_i{j}"))
        cur = cur.select("*", *stage)
        stage = []
        for j, c in enumerate(self.columns):
            if c in self.numeric:
                i, g = F.col(f"_i{j}"), self.numeric[c]
                k, arr, x = len(g) - 1, self._arr(g), F.col(f"_x{j}").cast("double")
                lo, hi = F.element_at(arr, i + 1), F.element_at(arr, i + 2)
                frac = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.5))
                u = F.when(x.isNotNull(), (i + F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0))) / k)
            else:
                lo, hi = F.col(f"_lo{j}"), F.col(f"_hi{j}")
                u = lo + (hi - lo) * unit_uniform(F.col("_key"), seed + 1000 + j)
            stage.append(F.when(u.isNotNull(), F.least(F.greatest(u, F.lit(1e-6)), F.lit(1 - 1e-6))).alias(f"_u{j}"))
        cur = cur.select("_key", *stage)
        return cur.select(F.col("_key").alias("row_key"), *[norm_ppf(F.col(f"_u{j}")).alias(c) for j, c in enumerate(self.columns)])

    # -- L02 ------------------------------------------------------------------
    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        c = np.array(self.corr)
        L = np.linalg.cholesky(c + np.eye(len(c)) * 1e-9)
        p = len(self.columns)
        cur = spark.range(n).withColumnRenamed("id", "row_id")
        cur = cur.select("row_id", *[unit_uniform(F.col("row_id"), seed * 1009 + j).alias(f"_e{j}") for j in range(p)])
        cur = cur.select("row_id", *[norm_ppf(F.col(f"_e{j}")).alias(f"_z{j}") for j in range(p)])
        ys = []
        for i in range(p):
            y = F.lit(0.0)
            for j in range(i + 1):
                if L[i, j] != 0:
                    y = y + F.col(f"_z{j}") * float(L[i, j])
            ys.append(y.alias(f"_y{i}"))
        cur = cur.select("row_id", *ys)
        cur = cur.select("row_id", *[F.least(F.greatest(norm_cdf(F.col(f"_y{i}")), F.lit(1e-9)), F.lit(1 - 1e-9))
                                     .alias(f"_u{i}") for i in range(p)])
        stage = []
        for i, name in enumerate(self.columns):
            u = F.col(f"_u{i}")
            if name in self.numeric:
                k = len(self.numeric[name]) - 1
                stage.append(F.least(F.floor(u * k), F.lit(k - 1)).cast("int").alias(f"_i{i}"))
        cur = cur.select("row_id", *[F.col(f"_u{i}") for i in range(p)], *stage)
        cols = []
        for i, name in enumerate(self.columns):
            if name in self.numeric:
                u, idx, g = F.col(f"_u{i}"), F.col(f"_i{i}"), self.numeric[name]
                k = len(g) - 1
                arr = self._arr(g)
                lo, hi = F.element_at(arr, idx + 1), F.element_at(arr, idx + 2)
                v = lo + (hi - lo) * (u * k - idx)
                if self.kinds.get(name) == "integer":
                    v = F.round(v).cast("long")
            else:
                v = F.col(f"_v{i}")
            cols.append(v.alias(name))
        if self.categorical:
            cur = self._drawn(cur)
        return cur.select("row_id", *cols)

    def _drawn(self, uniforms: DataFrame) -> DataFrame:
        """The rows with _v0, ...: the level of each categorical column that the row's uniform
        falls on. (0, 1) is cut into slots, many if there are many levels; a level stands
        in every slot that its share touches, so a row meets the few levels of its slot in an
        equi-join and takes the one whose share holds it (there always is one; a left join,
        since an inner one would work the uniforms out again to filter them). Rows fall evenly on the slots,
        however uneven the shares."""
        slots = max(SLOTS // 16, min(self.levels.count(), SLOTS))
        place = lambda x: F.floor(x * F.lit(slots))
        spans = self.levels.select("column", "value", "lo", "hi", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))).alias("_slot"))
        for i, c in enumerate(self.columns):
            if c in self.categorical:
                of = spans.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), "lo", "hi", "_slot")
                u = F.col(f"_u{i}")
                uniforms = (uniforms.join(of, (place(u) == F.col("_slot")) & (F.col("lo") <= u) & (u < F.col("hi")), "left")
                            .drop("lo", "hi", "_slot"))
        return uniforms


def fit_copula(df: DataFrame, key: str, columns: Sequence[str] | None = None, grid_points: int = 101,
               approx: bool = False, seed: int = 0) -> Copula:
    """Marginals from one counted table, and the score correlation (pairwise complete).
    ``approx`` takes the grids from a sketch."""
    columns = [c for c in (columns or df.columns) if c != key]
    nums = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    cats = [c for c in columns if c not in nums]
    probs = [i / (grid_points - 1) for i in range(grid_points)]
    grids: dict[str, list[float]] = {}
    counted = counted_values(df, cats if approx else columns)
    if approx and nums:
        row = df.agg(*[F.percentile_approx(q(c).cast("double"), probs, 10000).alias(f"g{i}") for i, c in enumerate(nums)]).first()
        grids = {c: [float(v) for v in row[f"g{i}"]] for i, c in enumerate(nums) if row[f"g{i}"]}
    elif nums:
        grids = {c: g for c, g in counted.quantiles(nums, probs).items() if g[0] is not None}
    columns = [c for c in columns if c in grids or c in cats and counted.distinct[c]]      # a column without values has no marginal
    cats = [c for c in cats if c in columns]
    levels = materialize(counted.numbered().where(F.col("column").isin(cats)).select(
        "column", "value", (F.col("before") / F.col("total")).alias("lo"), ((F.col("before") + F.col("n")) / F.col("total")).alias("hi"))) if cats else None
    kinds = {c: ("integer" if df.schema[c].dataType.typeName() in ("long", "integer", "short", "byte") else "float")
             for c in nums}
    cop = Copula(grids, cats, levels, list(columns), [], kinds)
    sc = materialize(cop.scores(df, key, seed))
    p = len(columns)
    corr = np.eye(p)
    at = {c: i for i, c in enumerate(columns)}
    for r in correlations(sc, columns, pairs_once=True).collect():
        i, j = at[r["a"]], at[r["b"]]
        corr[i, j] = corr[j, i] = 0.0 if r["r"] is None or np.isnan(r["r"]) else r["r"]
    w, _ = np.linalg.eigh(corr)
    if w.min() <= 1e-9:                       # diagonal lift to positive definite
        corr = corr + np.eye(p) * (1e-6 - w.min())
        d = np.sqrt(np.diag(corr))
        corr = corr / np.outer(d, d)
    cop.corr = corr.tolist()
    return cop


# ---------------------------------------------------------------------------
# L04 - L07 similarity
# ---------------------------------------------------------------------------
def numeric_similarity(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, similarity, acceptable): (exp(-|dmean|/std_real) + min/max std)/2, clipped."""
    def stats(df, tag):
        w = df.agg(*[x for i, c in enumerate(cols) for x in
                     (F.avg(q(c).cast("double")).alias(f"m{i}"), F.stddev_samp(q(c).cast("double")).alias(f"s{i}"))])
        args = []
        for i, c in enumerate(cols):
            args += [F.lit(c), F.col(f"m{i}"), F.col(f"s{i}")]
        return w.select(F.stack(F.lit(len(cols)), *args).alias("column", f"{tag}_mean", f"{tag}_std"))
    j = stats(real, "real").join(stats(synth, "synth"), "column")
    rm, sm, rs, ss = F.col("real_mean"), F.col("synth_mean"), F.col("real_std"), F.col("synth_std")
    both0 = (rs == 0) & (ss == 0)
    one0 = (rs == 0) | (ss == 0)
    mean_sim = (F.when(both0, F.when(rm == sm, 1.0).otherwise(0.0))
                .when(one0, F.exp(-F.abs(rm - sm))).otherwise(F.exp(-F.abs(rm - sm) / rs)))
    std_sim = F.when(both0, 1.0).when(one0, 0.0).otherwise(F.least(rs, ss) / F.greatest(rs, ss))
    sim = F.least(F.greatest((mean_sim + std_sim) / 2, F.lit(0.0)), F.lit(1.0))
    return j.select("column", "real_mean", "synth_mean", "real_std", "synth_std", sim.alias("similarity"),
                    (sim > 0.5).cast("int").alias("acceptable"))


def _level_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (df.select(*[q(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
            .where(F.col("value").isNotNull()).distinct())


def category_overlap(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, overlap, n_real, n_synth) from distinct (column, value) pairs."""
    r, s = _level_pairs(real, cols), _level_pairs(synth, cols)
    nr = r.groupBy("column").agg(F.count(F.lit(1)).alias("n_real"))
    ns = s.groupBy("column").agg(F.count(F.lit(1)).alias("n_synth"))
    common = r.join(s, ["column", "value"]).groupBy("column").agg(F.count(F.lit(1)).alias("n_common"))
    names = real.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    out = names.join(nr, "column", "left").join(ns, "column", "left").join(common, "column", "left")
    n_real = F.coalesce("n_real", F.lit(0))
    return out.select("column", F.when(n_real > 0, F.coalesce("n_common", F.lit(0)) / n_real).otherwise(1.0).alias("overlap"),
                      n_real.cast("bigint").alias("n_real"), F.coalesce("n_synth", F.lit(0)).cast("bigint").alias("n_synth"))


def level_differences(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, side, value): every level that only one side has, "new" or "missing"."""
    r, s = _level_pairs(real, cols), _level_pairs(synth, cols)
    return (s.join(r, ["column", "value"], "left_anti").select("column", F.lit("new").alias("side"), "value")
            .unionByName(r.join(s, ["column", "value"], "left_anti").select("column", F.lit("missing").alias("side"), "value")))


def schema_match(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One row: same width, same column order, types preserved (numeric ~ numeric)."""
    issues = []
    for f in real.schema.fields:
        if f.name in synth.columns:
            t = synth.schema[f.name].dataType
            if not (t == f.dataType or (isinstance(t, NumericType) and isinstance(f.dataType, NumericType))):
                issues.append(f"Type mismatch in {f.name}: {f.dataType.simpleString()} vs {t.simpleString()}")
    row = (len(real.columns) == len(synth.columns), real.columns == synth.columns, not issues, "; ".join(issues))
    return real.sparkSession.createDataFrame([row], "shape_match boolean, columns_match boolean, "
                                                    "types_preserved boolean, issues string")


def synthetic_quality(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Share of numeric columns with similarity > 0.5, share of text
    columns with overlap > 0.7, overall = schema ok and both shares > 0.6."""
    nums = [f.name for f in real.schema.fields if isinstance(f.dataType, NumericType) and f.name in synth.columns
            and isinstance(synth.schema[f.name].dataType, NumericType)]
    cats = [f.name for f in real.schema.fields if isinstance(f.dataType, StringType) and f.name in synth.columns]
    sm = schema_match(real, synth)
    stat = (numeric_similarity(real, synth, nums).agg(F.avg("acceptable").alias("statistical_quality"))
            if nums else real.sparkSession.createDataFrame([(1.0,)], "statistical_quality double"))
    dist = (category_overlap(real, synth, cats).agg(F.avg((F.col("overlap") > 0.7).cast("double")).alias("distribution_quality"))
            if cats else real.sparkSession.createDataFrame([(1.0,)], "distribution_quality double"))
    j = sm.crossJoin(stat).crossJoin(dist)
    overall = (F.col("shape_match") & F.col("columns_match") & F.col("types_preserved")
               & (F.col("statistical_quality") > 0.6) & (F.col("distribution_quality") > 0.6))
    return j.select("shape_match", "columns_match", "types_preserved", "statistical_quality",
                    "distribution_quality", overall.alias("overall_quality"))


def column_catalog(df: DataFrame, overrides: Mapping[str, str] | None = None, key: str | None = None) -> DataFrame:
    """(column, sdtype): id / numerical / categorical, with forced overrides."""
    rows = []
    for f in df.schema.fields:
        kind = "id" if f.name == key else ("numerical" if isinstance(f.dataType, NumericType) else "categorical")
        rows.append((f.name, (overrides or {}).get(f.name, kind)))
    return df.sparkSession.createDataFrame(rows, "column string, sdtype string")


def synthesize(df: DataFrame, key: str, n: int = 10000, seed: int = 0, approx: bool = False) -> DataFrame:
    """Narrow types, fit the copula, sample ``n`` rows."""
    from tabloom.operators.schema import narrow_types
    narrowed = narrow_types(df)
    cop = fit_copula(narrowed, key, approx=approx, seed=seed)
    return cop.sample(df.sparkSession, n, seed)
