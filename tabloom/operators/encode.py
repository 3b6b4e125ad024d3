"""Category encoding and scaling.

Fit = a fixed number of aggregate jobs whatever the column count; the result is
a small plan (levels, min/max, means) that is the only thing collected.
Transform = one ``select`` of built-in expressions (``=``, ``array_contains``,
arithmetic), so hundreds of flag columns stay one projection in codegen.

Level discovery (``fit_levels``) is exact and bounded: text columns are
unpivoted to (column, value) pairs, de-duplicated with map-side combine, counted
per column, and values are collected only for columns whose distinct count is
within the limit, so no column ever ships more than ``limit`` values.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tabloom.functions.text import map_lookup, split_parts, strip_ws
from tabloom.functions.domain import FLAG_DEFAULTS, GROUP_RULES, keyword_code
from tabloom.operators.schema import q
from tabloom.session import materialize

# Fixed values (synthetic-data encoder of the reference): missing token and the
# continuous feature range.
MISSING_TOKEN = "__MISSING__"
RANGE_MIN, RANGE_MAX = -1.0, 1.0
CLIP_EPSILON = 1e-8


def distinct_pairs(df: DataFrame, cols: Sequence[str], multi: bool = False) -> DataFrame:
    """Distinct (column, value) over text columns; ``multi`` explodes ';' parts."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string")
    if multi:
        arr = F.array(*[F.struct(F.lit(c).alias("column"), split_parts(q(c)).alias("parts")) for c in cols])
        long = df.select(F.inline(arr)).select("column", F.explode("parts").alias("value"))
    else:
        long = df.select(*[q(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).select("column", "value").distinct()


def fit_levels(df: DataFrame, cols: Sequence[str], limit: int | None, multi: bool = False
               ) -> tuple[dict[str, int], dict[str, list[str]]]:
    """(distinct count per column, sorted levels of columns with count <= limit)."""
    pairs = distinct_pairs(df, cols, multi).persist()     # read by both collects below
    try:
        counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        n = {r["column"]: r["n"] for r in counts.collect()}
        small = [c for c in cols if limit is None or n.get(c, 0) <= limit]
        levels = (pairs.where(F.col("column").isin(small)).groupBy("column")
                  .agg(F.array_sort(F.collect_list("value")).alias("levels")))
        lv = {r["column"]: list(r["levels"]) for r in levels.collect()} if small else {}
    finally:
        pairs.unpersist()
    return {c: n.get(c, 0) for c in cols}, lv


def semicolon_columns(df: DataFrame, cols: Sequence[str] | None = None, min_count: int = 1) -> list[str]:
    """Text columns where at least ``min_count`` values contain ';' (one aggregate)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)] if cols is None else list(cols)
    if not cols:
        return []
    row = df.agg(*[F.count_if(F.contains(q(c), F.lit(";"))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"] >= min_count]


# C03 -----------------------------------------------------------------------
@dataclass
class FittedStandardizer:
    mapping: dict[str, str]
    columns: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        cols = set(self.columns)
        return df.select(*[map_lookup(F.lower(strip_ws(q(c))), self.mapping).alias(c) if c in cols else q(c)
                           for c in df.columns])


class ValueStandardizer:
    """Dictionary standardiser on single-value text columns (no ';' anywhere)."""

    def __init__(self, mapping: Mapping[str, str] | None = None, columns: Sequence[str] | None = None):
        self.mapping, self.columns = dict(mapping or {}), columns

    def fit(self, df: DataFrame, semicolon_cols: Sequence[str] | None = None) -> FittedStandardizer:
        if self.columns is not None:
            return FittedStandardizer(self.mapping, list(self.columns))
        txt = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        semi = set(semicolon_columns(df, txt) if semicolon_cols is None else semicolon_cols)
        return FittedStandardizer(self.mapping, [c for c in txt if c not in semi])


# H01 / H02 -------------------------------------------------------------------
@dataclass
class FittedOneHot:
    levels: dict[str, list[str]]          # column -> sorted levels (after drop_first)
    preserve: list[str] = field(default_factory=list)

    def flag_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.levels.items() for v in vs]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [q(c) for c in df.columns if c not in self.levels or c in self.preserve]
        flags = [F.coalesce((q(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                 for c, vs in self.levels.items() if c in df.columns for v in vs]
        return df.select(*keep, *flags)


class OneHot:
    """One-hot single-value text columns with distinct count <= ``max_cardinality``.
    Levels sorted; null and unseen values give all zeros."""

    def __init__(self, max_cardinality: int = 10, drop_first: bool = False, preserve: Iterable[str] = (),
                 exclude: Iterable[str] = ()):
        self.max_cardinality, self.drop_first = max_cardinality, drop_first
        self.preserve, self.exclude = list(preserve), set(exclude)

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> FittedOneHot:
        if columns is None:
            columns = [f.name for f in df.schema.fields
                       if isinstance(f.dataType, StringType) and f.name not in self.exclude]
        counts, levels = fit_levels(df, columns, self.max_cardinality)
        out = {}
        for c in columns:
            if c in levels and counts[c] <= self.max_cardinality:
                vs = levels[c][1:] if self.drop_first else levels[c]
                out[c] = vs
        return FittedOneHot(out, self.preserve)


# H03 -----------------------------------------------------------------------
@dataclass
class FittedLabels:
    """``levels``: a written table (column, value, code), of any length. Codes number a
    column's sorted levels from 0."""
    columns: list[str]
    levels: DataFrame
    token: str

    def _of(self, c: str, value: str, code: str) -> DataFrame:
        return self.levels.where(F.col("column") == c).select(F.col("value").alias(value), F.col("code").cast("int").alias(code))

    def codes(self, df: DataFrame) -> DataFrame:
        """Label code per column; -1 for a value that the fit has not seen."""
        cur, names = df, list(df.columns)
        for i, c in enumerate(c for c in names if c in self.columns):
            cur = cur.join(self._of(c, f"_v{i}", f"_code{i}"), F.coalesce(q(c).cast("string"), F.lit(self.token)) == F.col(f"_v{i}"), "left")
            cur = cur.select(*[F.coalesce(f"_code{i}", F.lit(-1)).alias(n) if n == c else q(n) for n in names])
        return cur

    def decode(self, df: DataFrame) -> DataFrame:
        """Codes back to values; the token, and unknown codes, become null."""
        cur, names = df, list(df.columns)
        for i, c in enumerate(c for c in names if c in self.columns):
            cur = cur.join(self._of(c, f"_v{i}", f"_code{i}"), q(c) == F.col(f"_code{i}"), "left")
            cur = cur.select(*[F.when(F.col(f"_v{i}") != self.token, F.col(f"_v{i}")).alias(n) if n == c else q(n) for n in names])
        return cur

    @property
    def categories(self) -> dict[str, list[str]]:
        """{column: sorted levels}, for a column of flags each: as many as the output is wide."""
        out: dict[str, list[str]] = {c: [] for c in self.columns}
        for r in self.levels.orderBy("column", "code").collect():
            out[r["column"]].append(r["value"])
        return out

    def one_hot(self, df: DataFrame) -> DataFrame:
        levels, out = self.categories, []
        for c in df.columns:
            if c in self.columns:
                v = F.coalesce(q(c).cast("string"), F.lit(self.token))
                out += [(v == F.lit(k)).cast("int").alias(f"{c}_{k}") for k in levels[c]]
            else:
                out.append(q(c))
        return df.select(*out)


class LabelEncoder:
    """Sorted levels with the missing token as a level (H03), numbered where they lie:
    a column may have any number of them."""

    def __init__(self, token: str = MISSING_TOKEN):
        self.token = token

    def fit(self, df: DataFrame, columns: Sequence[str]) -> FittedLabels:
        from tabloom.operators.counted import counted_values
        filled = df.select(*[F.coalesce(q(c).cast("string"), F.lit(self.token)).alias(c) for c in columns])
        return FittedLabels(list(columns), materialize(counted_values(filled).numbered().select("column", "value", "code")), self.token)


# H04 -----------------------------------------------------------------------
def decode_flags(df: DataFrame, groups: Mapping[str, Mapping[str, str]], default: str = "missing",
                 first_match: bool = False, keep_flags: bool = False) -> DataFrame:
    """Flags back to a label per group: ``groups = {output: {label: flag_column}}``.

    All active labels (in mapping order) joined by ';'; none -> ``default``.
    ``first_match`` keeps only the first active label (special/binary groups).
    """
    out = [q(c) for c in df.columns] if keep_flags else None
    flag_cols = {fc for m in groups.values() for fc in m.values()}
    if out is None:
        out = [q(c) for c in df.columns if c not in flag_cols]
    have = set(df.columns)
    for name, mapping in groups.items():
        hits = [F.when(q(fc) == 1, F.lit(label)) for label, fc in mapping.items() if fc in have]
        if not hits:
            out.append(F.lit(default).alias(name))
            continue
        if first_match:
            out.append(F.coalesce(*hits, F.lit(default)).alias(name))
        else:
            active = F.filter(F.array(*hits), lambda x: x.isNotNull())
            out.append(F.when(F.size(active) > 0, F.array_join(active, ";")).otherwise(F.lit(default)).alias(name))
    return df.select(*out)


# H05 -----------------------------------------------------------------------
def activate_group(df: DataFrame, source: str, rules: Sequence[tuple[str, str]], flags: Sequence[str],
                   default: str | None = None) -> DataFrame:
    """Switch on one flag of a group from a raw input by ordered rules.

    ``rules`` = [(keyword, flag)] tested in order with case-insensitive
    ``contains``; the first hit wins, else ``default`` (a flag name, or the
    first flag when None). Adds every flag of ``flags`` as 0/1.
    """
    src = F.lower(q(source).cast("string"))
    chosen = F.lit(default if default is not None else flags[0])
    for kw, flag in reversed(list(rules)):
        chosen = F.when(F.contains(src, F.lit(kw.lower())), F.lit(flag)).otherwise(chosen)
    return df.select("*", *[(chosen == F.lit(f)).cast("int").alias(f) for f in flags])


def flag_with(flags: Sequence[str], words: Sequence[str]) -> str | None:
    """The first flag that holds the first word that any flag holds."""
    return next((f for w in words for f in flags if w in f.lower()), None)


def activate_groups(df: DataFrame, flags: Sequence[str], rules=GROUP_RULES, defaults: Sequence[str] = FLAG_DEFAULTS) -> DataFrame:
    """Add every flag as 0/1, one of each group (the name before the last underscore)
    switched on by the group's rules over its raw input, all in one ``select``.

    A rule's flag is looked up when the plan is made; each rule has any-of and
    none-of words, a null or absent input counts as empty, and a rule whose flag the
    group lacks switches nothing on. Groups without rules take a default flag, or
    their first. Flags without an underscore belong to no group and stay off."""
    groups: dict[str, list[str]] = {}
    for f in flags:
        groups.setdefault(f.rpartition("_")[0], []).append(f)
    on: dict[str, Column] = {}
    for base, members in groups.items():
        found = next((r for r in rules if base and r[0] in base), None)
        if found is not None:
            _, source, cases, rest = found
            raw = q(source) if source in df.columns else F.lit(None)
            chosen = keyword_code(raw, [(any_of, none_of, flag_with(members, words)) for any_of, none_of, words in cases],
                                  flag_with(members, rest))
        else:
            chosen = F.lit((flag_with(members, defaults) or members[0]) if base else None)
        for f in members:
            on[f] = F.coalesce(chosen.cast("string") == F.lit(f), F.lit(False)).cast("int")
    return df.select("*", *[on[f].alias(f) for f in flags])


# H06 / H07 -------------------------------------------------------------------
@dataclass
class FittedRange:
    kinds: dict[str, str]                   # column -> continuous | discrete
    lo: dict[str, float]
    hi: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.kinds:
                out.append(q(c))
                continue
            x = (q(c).cast("string")).try_cast("double")
            lo, hi = self.lo[c], self.hi[c]
            if self.kinds[c] == "discrete":
                v = (F.coalesce(x, F.lit(lo)) - lo) / ((hi - lo) + CLIP_EPSILON)
                v = F.least(F.greatest(v, F.lit(RANGE_MIN)), F.lit(RANGE_MAX))
            else:
                x = F.coalesce(x, F.lit(0.0))
                scale = (RANGE_MAX - RANGE_MIN) / (hi - lo) if hi != lo else 1.0
                v = (x - lo) * scale + RANGE_MIN
            out.append(v.alias(c))
        return df.select(*out)

    def inverse(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.kinds:
                out.append(q(c))
                continue
            v = F.least(F.greatest(q(c), F.lit(RANGE_MIN)), F.lit(RANGE_MAX))
            lo, hi = self.lo[c], self.hi[c]
            if self.kinds[c] == "discrete":
                rng = (hi - lo) if hi - lo > 0 else 1.0
                out.append(F.round(v * rng + lo).cast("long").alias(c))
            else:
                scale = (hi - lo) / (RANGE_MAX - RANGE_MIN) if hi != lo else 1.0
                out.append(((v - RANGE_MIN) * scale + lo).alias(c))
        return df.select(*out)


class RangeScaler:
    """[-1, 1] min-max for continuous columns; (x-min)/(range+1e-8) clipped for discrete."""

    def fit(self, df: DataFrame, kinds: Mapping[str, str]) -> FittedRange:
        cols = list(kinds)
        aggs = []
        for i, c in enumerate(cols):
            x = (q(c).cast("string")).try_cast("double")
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        return FittedRange(dict(kinds), {c: float(row[f"lo{i}"]) for i, c in enumerate(cols)},
                           {c: float(row[f"hi{i}"]) for i, c in enumerate(cols)})


def argmax_level(flag_cols: Sequence[str], levels: Sequence[str], token: str = MISSING_TOKEN) -> Column:
    """H07 categorical inverse: level of the largest score (first on ties); token -> null."""
    arr = F.array(*[q(c).cast("double") for c in flag_cols])
    pos = F.array_position(arr, F.array_max(arr))
    lv = F.element_at(F.array(*[F.lit(v) for v in levels]), pos.cast("int"))
    return F.nullif(lv, F.lit(token))


# H08 / H09 -------------------------------------------------------------------
@dataclass
class FittedAffine:
    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[((q(c) - self.shift[c]) / self.scale[c]).alias(c) if c in self.shift else q(c)
                           for c in df.columns])


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> FittedAffine:
    """Mean and population std (a zero std scales by 1)."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))]).first()
    return FittedAffine({c: row[f"m{i}"] for i, c in enumerate(cols)},
                        {c: (row[f"s{i}"] or 1.0) for i, c in enumerate(cols)})


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> FittedAffine:
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"))]).first()
    return FittedAffine({c: float(row[f"lo{i}"]) for i, c in enumerate(cols)},
                        {c: (float(row[f"hi{i}"] - row[f"lo{i}"]) or 1.0) for i, c in enumerate(cols)})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
