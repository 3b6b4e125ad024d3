"""Multi-value (semicolon) columns.

A cell ``"a; b; a"`` is parsed once into ``array<string>`` (null -> [], split,
strip, drop empties). Global value counts come from ``explode`` + ``groupBy``
(map-side combine, so a value held by a third of all rows costs one partial row
per partition). Strategies are fitted: only bounded plans reach the driver
(top-k list, frequent list bounded by 1/threshold, group map); per-row flags are
``array_contains``/``exists`` expressions in one ``select``.

``avg_frequency`` (G07) joins the parts of each distinct cell to the counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import split_parts
from tabloom.operators.schema import q
from tabloom.session import materialize


def parts(col: str | Column, sep: str = ";") -> Column:
    return split_parts(q(col) if isinstance(col, str) else col, sep)


def value_counts(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    """(value, n): occurrences of each part over all rows (repeats counted)."""
    return (df.select(F.explode(parts(col, sep)).alias("value"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("n")))


def safe_name(s: str) -> str:
    return s.replace(" ", "_").replace("-", "_")


# G01 -----------------------------------------------------------------------
def multivalue_stats(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    """One row: unique values, occurrences, rows, values per row (min/max/mean/median)."""
    per_row = df.where(q(col).isNotNull()).select(F.size(parts(col, sep)).alias("k"))
    rows = per_row.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("n_occurrences"),
                       F.min("k").alias("min_per_row"), F.max("k").alias("max_per_row"),
                       F.avg("k").alias("mean_per_row"), F.median("k").alias("median_per_row"))
    uniq = value_counts(df, col, sep).agg(F.count(F.lit(1)).alias("n_unique"))
    return rows.crossJoin(uniq).select(
        F.lit(col).alias("column"), F.col("n_unique").cast("bigint").alias("n_unique"),
        F.col("n_occurrences").cast("bigint").alias("n_occurrences"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("min_per_row").cast("int").alias("min_per_row"), F.col("max_per_row").cast("int").alias("max_per_row"),
        "mean_per_row", F.col("median_per_row").cast("double").alias("median_per_row"))


def multivalue_top(df: DataFrame, col: str, k: int = 15, sep: str = ";") -> DataFrame:
    """Top-k values (count desc, value asc) with % of non-null rows."""
    n_rows = df.where(q(col).isNotNull()).agg(F.count(F.lit(1)).alias("rows"))
    top = value_counts(df, col, sep).orderBy(F.desc("n"), "value").limit(k)
    return top.crossJoin(n_rows).select("value", F.col("n").cast("bigint").alias("n"),
                                        (F.col("n") * 100.0 / F.col("rows")).alias("pct_rows"))


# G02 -----------------------------------------------------------------------
def frequency_of_frequencies(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    return (value_counts(df, col, sep).groupBy(F.col("n").alias("frequency"))
            .agg(F.count(F.lit(1)).alias("n_values")))


# G03 / G04 -------------------------------------------------------------------
class FittedMultiHot:
    def __init__(self, levels: dict[str, list[str]], preserve: Sequence[str] = (), sep: str = ";"):
        self.levels, self.preserve, self.sep = levels, list(preserve), sep

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [q(c) for c in df.columns if c not in self.levels or c in self.preserve]
        existing = set(df.columns)
        flags = []
        for c, vs in self.levels.items():
            if c not in existing:
                continue
            p = parts(c, self.sep)
            for v in vs:
                name = f"{c}__{v}"
                if name in existing:          # clash with an existing column: dropped
                    continue
                flags.append(F.array_contains(p, F.lit(v)).cast("int").alias(name))
        return df.select(*keep, *flags)


class MultiValueEncoder:
    """0/1 column ``col__value`` per value of multi-value columns with at most
    ``max_cardinality`` distinct values; originals dropped unless preserved."""

    def __init__(self, max_cardinality: int = 10, preserve: Sequence[str] = (), sep: str = ";"):
        self.max_cardinality, self.preserve, self.sep = max_cardinality, list(preserve), sep

    def fit(self, df: DataFrame, columns: Sequence[str]) -> FittedMultiHot:
        from tabloom.operators.encode import fit_levels
        counts, levels = fit_levels(df, columns, self.max_cardinality, multi=True)
        keep = {c: levels[c] for c in columns if c in levels and 0 < counts[c] <= self.max_cardinality}
        return FittedMultiHot(keep, self.preserve, self.sep)


# G05 -----------------------------------------------------------------------
def top_values(df: DataFrame, col: str, k: int, sep: str = ";") -> list[str]:
    return [r["value"] for r in value_counts(df, col, sep).orderBy(F.desc("n"), "value").limit(k).collect()]


def flags_for(col: str, values: Sequence[str], prefix: str, rest_name: str, sep: str = ";") -> list[Column]:
    p = parts(col, sep)
    out = [F.array_contains(p, F.lit(v)).cast("int").alias(safe_name(f"{col}_{prefix}{v}")) for v in values]
    lit_vals = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    out.append(F.exists(p, lambda x: ~F.array_contains(lit_vals, x)).cast("int").alias(f"{col}_{rest_name}"))
    return out


def multivalue_topk(df: DataFrame, col: str, k: int = 20, sep: str = ";", values: Sequence[str] | None = None
                    ) -> tuple[list[Column], list[str]]:
    vals = top_values(df, col, k, sep) if values is None else list(values)
    cols = flags_for(col, vals, "top_", "other", sep)
    return cols, [safe_name(f"{col}_top_{v}") for v in vals] + [f"{col}_other"]


# G06 -----------------------------------------------------------------------
def frequent_values(df: DataFrame, col: str, threshold: float = 0.05, sep: str = ";") -> list[str]:
    """Values with count >= floor(rows * threshold); rows include null cells. There are
    at most (parts per row) / threshold of them."""
    n = df.count()
    vc = value_counts(df, col, sep).where(F.col("n") >= max(int(n * threshold), 1))
    return [r["value"] for r in vc.orderBy("value").collect()]


def multivalue_frequent(df: DataFrame, col: str, threshold: float = 0.05, sep: str = ";",
                        values: Sequence[str] | None = None) -> tuple[list[Column], list[str]]:
    vals = frequent_values(df, col, threshold, sep) if values is None else list(values)
    return flags_for(col, vals, "freq_", "rare", sep), [safe_name(f"{col}_freq_{v}") for v in vals] + [f"{col}_rare"]


# G07 -----------------------------------------------------------------------
def most_common(df: DataFrame, col: str, sep: str = ";") -> str | None:
    """The commonest part, ties to the smallest."""
    return _commonest(value_counts(df, col, sep))


def _commonest(counts: DataFrame) -> str | None:
    return counts.agg(F.min_by("value", F.struct(-F.col("n"), F.col("value")))).first()[0]


def multivalue_counts(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    """Adds count, unique_count, has_most_common, avg_frequency for ``col``.

    Every part meets its global count in a join on the value; the mean is put
    together per distinct cell text, so equal cells are worked out once, and
    joined back to the rows. Neither join needs a key, and a hot value or cell is
    one row on the counted side (AQE splits the other)."""
    return _with_counts(df, col, sep)[0]


def _with_counts(df: DataFrame, col: str, sep: str) -> tuple[DataFrame, str | None]:
    """The frame of ``multivalue_counts`` and the commonest part; the parts are counted once."""
    vc = materialize(value_counts(df, col, sep))
    top = _commonest(vc)
    p = parts(col, sep)
    base = [F.size(p).alias(f"{col}_count"), F.size(F.array_distinct(p)).alias(f"{col}_unique_count")]
    if top is not None:
        base.append(F.array_contains(p, F.lit(top)).cast("int").alias(f"{col}_has_most_common"))
    cells = df.select(q(col).alias("_cell")).distinct()
    mean = (cells.select("_cell", F.explode(parts(F.col("_cell"), sep)).alias("value")).join(vc, "value")
            .groupBy("_cell").agg(F.avg("n").alias("_mean")))
    return (df.join(mean, q(col) == F.col("_cell"), "left")
            .select(*[q(c) for c in df.columns], *base, F.coalesce("_mean", F.lit(0.0)).alias(f"{col}_avg_frequency"))), top


# G09 -----------------------------------------------------------------------
def multivalue_groups(col: str, hierarchy: Mapping[str, str], sep: str = ";") -> list[Column]:
    p = parts(col, sep)
    cats = sorted(set(hierarchy.values()))
    out = []
    for cat in cats:
        members = F.array(*[F.lit(v) for v, c in sorted(hierarchy.items()) if c == cat])
        out.append(F.arrays_overlap(p, members).cast("int").alias(f"{col}_category_{cat}".replace(" ", "_")))
    return out


# G10 -----------------------------------------------------------------------
def recommend_strategy(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    vc = value_counts(df, col, sep)
    s = vc.agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))
    band = (F.when(F.col("n_unique") > 100, "very_high").when(F.col("n_unique") > 50, "high").otherwise("moderate"))
    first = (F.when(F.col("n_unique") > 100, "count_features").when(F.col("n_unique") > 50, "top_k")
             .otherwise("frequency_threshold"))
    return s.select(F.lit(col).alias("column"), F.col("n_unique").cast("bigint").alias("n_unique"),
                    band.alias("cardinality"), first.alias("recommended"),
                    (F.col("max_n") / F.col("min_n") > 100).cast("int").alias("skewed"))


# G16 -----------------------------------------------------------------------
def expand_multivalue(df: DataFrame, cols: Sequence[str], strategy: str = "top_k",
                      preserve: Sequence[str] = (), sep: str = ";", **kw
                      ) -> tuple[DataFrame, DataFrame]:
    """Apply one strategy to several columns; returns (frame, mapping), where the mapping
    tells of each new column (column, position, new_column) what it holds: ``kind`` (see
    ``expected_flag``; also "mean", a number that is no flag) and, for flags, the
    ``captured`` values. Strategies: top_k (k), frequency_threshold (threshold),
    hierarchical (hierarchy; without one the column is left as it is), count_features."""
    spark = df.sparkSession
    mapping: list[tuple[str, int, str, str, list[str] | None]] = []
    out = df
    for col in cols:
        if col not in out.columns:
            continue
        if strategy == "top_k":
            vals = top_values(df, col, kw.get("k", 20), sep)
            new_cols, names = multivalue_topk(df, col, sep=sep, values=vals)
            kinds = [("binary", [v]) for v in vals] + [("other", vals)]
        elif strategy == "frequency_threshold":
            vals = frequent_values(df, col, kw.get("threshold", 0.05), sep)
            new_cols, names = multivalue_frequent(df, col, sep=sep, values=vals)
            kinds = [("binary", [v]) for v in vals] + [("other", vals)]
        elif strategy == "hierarchical":
            h = kw.get("hierarchy") or {}
            if not h:
                continue          # no map given: the column is left as it is
            new_cols = multivalue_groups(col, h, sep)
            names = [f"{col}_category_{c}".replace(" ", "_") for c in sorted(set(h.values()))]
            kinds = [("group", sorted(v for v, c in h.items() if c == cat)) for cat in sorted(set(h.values()))]
        elif strategy == "count_features":
            before, new_cols = out.columns, None
            out, most = _with_counts(out, col, sep)
            names = [c for c in out.columns if c not in before]
            kinds = [("count", None), ("unique_count", None)] + ([("binary", [most])] if most is not None else []) + [("mean", None)]
        else:
            raise ValueError(f"unknown strategy {strategy}")
        if new_cols is not None:
            out = out.select("*", *new_cols)
        if col not in preserve:
            out = out.drop(col)
        mapping += [(col, i, n, kind, held) for i, (n, (kind, held)) in enumerate(zip(names, kinds))]
    return out, spark.createDataFrame(mapping, "column string, position int, new_column string, kind string, captured array<string>")


# G11 -----------------------------------------------------------------------
def expected_flag(col: str, kind: str, arg=None, sep: str = ";") -> Column:
    """Recomputed value of a processed column from the original cell."""
    p = parts(col, sep)
    if kind == "binary":
        return F.array_contains(p, F.lit(arg if isinstance(arg, str) else arg[0])).cast("int")
    if kind == "other":
        vals = F.array(*[F.lit(v) for v in arg]) if arg else F.array().cast("array<string>")
        return F.exists(p, lambda x: ~F.array_contains(vals, x)).cast("int")
    if kind == "count":
        return F.size(p)
    if kind == "unique_count":
        return F.size(F.array_distinct(p))
    if kind == "group":
        return F.arrays_overlap(p, F.array(*[F.lit(v) for v in arg])).cast("int")
    raise ValueError(f"no rule recomputes {kind}")


def validate_flags(df: DataFrame, col: str, checks: Sequence[tuple[str, str, object]], sep: str = ";") -> DataFrame:
    """(new_column, kind, matches, total, match_rate): recomputed vs actual, one
    aggregate over a frame holding both the original cell and the new columns."""
    aggs = [F.count(F.lit(1)).alias("_t")]
    for i, (name, kind, arg) in enumerate(checks):
        aggs.append(F.count_if(expected_flag(col, kind, arg, sep) == q(name)).alias(f"m{i}"))
    wide = df.agg(*aggs)
    args = []
    for i, (name, kind, _) in enumerate(checks):
        args += [F.lit(name), F.lit(kind), F.col(f"m{i}")]
    return wide.select("_t", F.stack(F.lit(len(checks)), *args).alias("new_column", "kind", "m")).select(
        "new_column", "kind", F.col("m").cast("bigint").alias("matches"), F.col("_t").cast("bigint").alias("total"),
        (F.col("m") * 100.0 / F.col("_t")).alias("match_rate"))


def checks_for(mapping: DataFrame, col: str) -> list[tuple[str, str, object]]:
    """The check list of ``col``'s new columns, as the mapping of ``expand_multivalue``
    tells them; means can't be recomputed from a cell and are left out."""
    rows = mapping.where((F.col("column") == col) & (F.col("kind") != "mean")).orderBy("position").collect()
    return [(r["new_column"], r["kind"], r["captured"]) for r in rows]


# G12 -----------------------------------------------------------------------
def validate_rows(df: DataFrame, col: str, new_cols: Sequence[str], key: str, n: int = 5, seed: int = 0,
                  sep: str = ";") -> DataFrame:
    """n rows in hash order of (key, seed): original, parsed list, all the new columns, and
    how many of these flags are set."""
    from tabloom.functions.hashing import mix32
    h = mix32(q(key), seed)
    hits = sum([F.coalesce((q(c) == 1).cast("int"), F.lit(0)) for c in new_cols], F.lit(0))
    return (df.select(q(key).alias("key"), h.alias("_h"), q(col).alias("original"),
                      F.array_join(parts(col, sep), "|").alias("parsed"), *[q(c) for c in new_cols], hits.alias("n_set"))
            .orderBy("_h", "key").limit(n).drop("_h"))


# G13 -----------------------------------------------------------------------
def validate_statistics(df: DataFrame, col: str, count_col: str | None, flag_cols: Sequence[str],
                        sep: str = ";") -> DataFrame:
    """One row: values per row mean/std (sample), processed count mean/std and
    their correlation, number of flag columns holding values other than 0/1."""
    k = F.size(parts(col, sep)).cast("double")
    aggs = [F.avg(k).alias("orig_mean"), F.stddev_samp(k).alias("orig_std")]
    if count_col:
        c = q(count_col).cast("double")
        aggs += [F.avg(c).alias("count_mean"), F.stddev_samp(c).alias("count_std"), F.corr(k, c).alias("count_corr")]
    bad = [F.count_if(~q(f).isin(0, 1) & q(f).isNotNull()) for f in flag_cols]
    nb = sum([F.when(b > 0, 1).otherwise(0) for b in bad], F.lit(0)) if bad else F.lit(0)
    aggs.append(nb.cast("int").alias("non_binary_columns"))
    return df.agg(*aggs)


# G14 -----------------------------------------------------------------------
def information_loss(df: DataFrame, col: str, captured: Sequence[str], other_col: str | None = None,
                     sep: str = ";") -> DataFrame:
    """One row: unique values, captured, capture rate, lost values (first 10 sorted), rows with 'other'."""
    vals = value_counts(df, col, sep).where(F.col("value") != "nan").select("value")
    cap = df.sparkSession.createDataFrame([(v,) for v in captured], "value string")
    lost = vals.join(cap, "value", "left_anti")
    total = vals.agg(F.count(F.lit(1)).alias("n_unique"))
    got = vals.join(cap, "value", "left_semi").agg(F.count(F.lit(1)).alias("n_captured"))
    lost10 = lost.orderBy("value").limit(10).agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("lost_values"))
    out = total.crossJoin(got).crossJoin(lost10)
    other = (df.agg(F.sum(q(other_col)).cast("bigint").alias("rows_with_other")) if other_col
             else df.sparkSession.createDataFrame([(None,)], "rows_with_other bigint"))
    return out.crossJoin(other).select(
        F.col("n_unique").cast("bigint").alias("n_unique"), F.col("n_captured").cast("bigint").alias("n_captured"),
        F.when(F.col("n_unique") > 0, F.col("n_captured") * 100.0 / F.col("n_unique")).otherwise(0.0).alias("capture_rate"),
        F.coalesce(F.col("lost_values"), F.lit("")).alias("lost_values"), "rows_with_other")


# G15 -----------------------------------------------------------------------
def validation_summary(original: DataFrame, processed: DataFrame, mapping: DataFrame) -> DataFrame:
    """(column, n_new, n_missing, n_non_binary, columns_before, columns_after) from the
    mapping of ``expand_multivalue``: which of the new columns are there, and how many
    of the flags among them (by kind) hold anything but 0 and 1; one aggregate."""
    have = set(processed.columns)
    new = mapping.orderBy("column", "position").collect()                # a row a new column
    flags = [r["new_column"] for r in new if r["kind"] in ("binary", "other", "group") and r["new_column"] in have]
    bad = processed.agg(*[F.count_if(~q(c).isin(0, 1) & q(c).isNotNull()).alias(f"b{i}") for i, c in enumerate(flags)]).first() if flags else []
    wrong = {c for c, n in zip(flags, bad) if n}
    by: dict[str, list[str]] = {}
    for r in new:
        by.setdefault(r["column"], []).append(r["new_column"])
    out = [(col, len(cols), sum(c not in have for c in cols), sum(c in wrong for c in cols), len(original.columns), len(processed.columns))
           for col, cols in by.items()]
    return processed.sparkSession.createDataFrame(
        out, "column string, n_new int, n_missing int, n_non_binary int, columns_before int, columns_after int")
