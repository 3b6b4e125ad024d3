"""The ten-step preprocessing plan as a fit/transform pair.

Steps, in order: lower/strip text (C01), standardise names (B02), drop sparse
columns + fill (D02-D04), clean values (C02), tidy multi-value cells (C05),
map single values (C03), multi-hot (G03), one-hot (H01), fix names (B04),
validate (E17).

``fit`` scans the frame once, whatever its width, for a table of counted values
(``operators.counted``). From that come missing counts, ';' columns and exact
medians; cleaning, tidying and mapping then run once a distinct value instead of
once a row, and the levels of columns within the cardinality limit are collected.
Everything learned (dropped columns, fills, levels) is kept, so training and
scoring frames get one schema (T3/T4). ``transform`` is a single lazy chain of
projections that Catalyst collapses into one ``Project``.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tabloom.functions.text import clean_value, map_lookup, normalize_text, split_parts, tidy_multivalue
from tabloom.operators.counted import CountedValues, counted_values
from tabloom.operators.encode import FittedOneHot
from tabloom.operators.missing import fitted_medians, value
from tabloom.operators.multivalue import FittedMultiHot
from tabloom.operators.schema import fixed_names, q, standardize_columns

# Default protected columns of the reference factory.
DEFAULT_KEEP = [
    "project_prf_case_tool_used",
    "process_pmf_prototyping_used",
    "tech_tf_client_roles",
    "tech_tf_type_of_server",
    "tech_tf_clientserver_description",
]

STEPS = ["validator", "column_standardizer", "missing_handler", "cat_value_cleaner",
         "semicolon_processor", "cat_value_standardizer", "multi_value_encoder",
         "categorical_encoder", "column_fixer", "final_validator"]


@dataclass
class FittedPreprocessor:
    target: str | None
    input_columns: list[str]
    drop: list[str]
    text_fill: str
    numeric_fill: dict[str, float]
    multi_columns: list[str]
    single_columns: list[str]
    mapping: dict[str, str]
    multi_levels: dict[str, list[str]]
    single_levels: dict[str, list[str]]
    preserve: list[str] = field(default_factory=list)
    null_token: str | None = None

    # -- the four lazy stages -------------------------------------------------
    def _names(self, df: DataFrame) -> DataFrame:
        return standardize_columns(normalize_text(df, self.null_token), self.target)

    def _filled(self, x: Column) -> Column:
        """A text column after ``_names`` filled and cleaned. Lower and stripped it is
        already, so only the fill value (a constant) and a null token go through all of it."""
        if self.null_token is not None:
            return clean_value(F.coalesce(x, F.lit(self.text_fill)))
        return F.coalesce(F.replace(x, F.lit("-"), F.lit("_")), clean_value(F.lit(self.text_fill)))

    def _single(self, x: Column) -> Column:
        """A single-value text column filled, cleaned and mapped."""
        return map_lookup(self._filled(x), self.mapping)

    def _multi(self, x: Column) -> Column:
        """A multi-value text column filled, cleaned, tidied and mapped."""
        return tidy_multivalue(self._filled(x), self.mapping, lowered=True)

    def _clean(self, df: DataFrame) -> DataFrame:
        """Names done -> drop/fill -> clean values -> tidy multi -> map single."""
        out = []
        multi, single = set(self.multi_columns), set(self.single_columns)
        for c in df.columns:
            if c in self.drop:
                continue
            t = df.schema[c].dataType
            x = q(c)
            if isinstance(t, StringType):
                if c in multi:
                    x = self._multi(x)
                elif c in single:
                    x = self._single(x)
                else:
                    x = self._filled(x)
            elif c in self.numeric_fill and self.numeric_fill[c] is not None:
                x = F.coalesce(value(df, c), F.lit(self.numeric_fill[c]).cast(t))
            out.append(x.alias(c))
        return df.select(*out)

    def _encode(self, df: DataFrame) -> DataFrame:
        df = FittedMultiHot(self.multi_levels, self.preserve).transform(df)
        df = FittedOneHot(self.single_levels, self.preserve).transform(df)
        return df.toDF(*fixed_names(df.columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return self._encode(self._clean(self._names(df)))

    # -- X08 ------------------------------------------------------------------
    def output_columns(self) -> list[str]:
        kept = [c for c in self.input_columns if c not in self.drop
                and not (c in self.multi_levels and c not in self.preserve)
                and not (c in self.single_levels and c not in self.preserve)]
        multi = [f"{c}__{v}" for c, vs in self.multi_levels.items() for v in vs if f"{c}__{v}" not in self.input_columns]
        single = [f"{c}_{v}" for c, vs in self.single_levels.items() for v in vs]
        return fixed_names(kept + multi + single)

    # -- X07 ------------------------------------------------------------------
    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "FittedPreprocessor":
        return FittedPreprocessor(**json.loads(text))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the plan as a one-row JSON table (any Hadoop filesystem)."""
        spark.createDataFrame([(self.to_json(),)], "plan string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPreprocessor":
        return FittedPreprocessor.from_json(spark.read.text(path).first()[0])


class Preprocessor:
    """X02 factory: ``Preprocessor(target, threshold=0.7, keep=..., max_cardinality=10)``."""

    def __init__(self, target: str | None = None, threshold: float = 0.7, keep: Iterable[str] | None = None,
                 max_cardinality: int = 10, mapping: Mapping[str, str] | None = None,
                 fill_value: str = "missing", preserve: Sequence[str] = (), null_token: str | None = None,
                 median: str = "exact"):
        self.target, self.threshold = target, threshold
        self.keep = set(DEFAULT_KEEP if keep is None else keep)
        self.max_cardinality, self.mapping = max_cardinality, dict(mapping or {})
        self.fill_value, self.preserve, self.null_token = fill_value, list(preserve), null_token
        # "exact" (tabloom.operators.quantiles) or "approx" (percentile_approx sketch)
        self.median = median

    def fit(self, df: DataFrame) -> FittedPreprocessor:
        plan = FittedPreprocessor(self.target, [], [], self.fill_value, {}, [], [], self.mapping, {}, {},
                                  self.preserve, self.null_token)
        named = plan._names(df)
        cols = named.columns
        nums = [f.name for f in named.schema.fields if isinstance(f.dataType, NumericType)]
        txt = [f.name for f in named.schema.fields if isinstance(f.dataType, StringType)]
        exact = self.median == "exact"
        counted = counted_values(named, presence=[c for c in cols if c not in txt and not (exact and c in nums)])
        n = counted.rows or 1
        plan.input_columns = cols
        plan.drop = [c for c, m in counted.missing.items() if m / n > self.threshold and c not in self.keep]
        kept = [c for c in nums if c not in plan.drop]
        plan.numeric_fill = ({c: m[0] for c, m in counted.quantiles(kept, [0.5]).items()} if exact
                             else fitted_medians(named, kept, self.median))
        semi = counted.with_semicolons()
        plan.multi_columns = [c for c in txt if c in semi and c not in plan.drop]
        plan.single_columns = [c for c in txt if c not in semi and c not in plan.drop]
        lv = self._levels(plan, counted)
        plan.multi_levels = {c: lv[c] for c in plan.multi_columns if c in lv}
        plan.single_levels = {c: lv[c] for c in plan.single_columns if c in lv}
        return plan

    def _levels(self, plan: FittedPreprocessor, counted: CountedValues) -> dict[str, list[str]]:
        """Sorted levels, as the encoders will see them, of the text columns that have at
        most ``max_cardinality``. One level more than that is kept of a larger column,
        in every task before the shuffle, so no task or driver holds all its values."""
        one = F.array(plan._single(F.col("text")))
        many = split_parts(plan._multi(F.col("text")))
        parts = [counted.values(cols).select("column", F.explode(x).alias("value"))
                 for cols, x in ((plan.single_columns, one), (plan.multi_columns, many)) if cols]
        if not parts:
            return {}
        pairs = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        order = Window.partitionBy("column").orderBy("value")
        few = (pairs.where(F.col("value").isNotNull()).distinct().withColumn("place", F.row_number().over(order))
               .where(F.col("place") <= self.max_cardinality + 1))
        found = few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("levels")).collect()
        return {counted.names[r["column"]]: list(r["levels"]) for r in found if len(r["levels"]) <= self.max_cardinality}


# X04 -----------------------------------------------------------------------
def processing_report(before: DataFrame, after: DataFrame, target: str | None, steps: Sequence[str] = STEPS,
                      with_timestamp: bool = True) -> DataFrame:
    """One row of original/processed shape, target found, steps (and time)."""
    nb = before.agg(F.count(F.lit(1)).alias("original_rows"))
    na = after.agg(F.count(F.lit(1)).alias("processed_rows"))
    cols = [F.col("original_rows").cast("bigint").alias("original_rows"),
            F.lit(len(before.columns)).cast("int").alias("original_columns"),
            F.col("processed_rows").cast("bigint").alias("processed_rows"),
            F.lit(len(after.columns)).cast("int").alias("processed_columns"),
            F.lit(bool(target and target in after.columns)).alias("target_found"),
            F.lit("; ".join(steps)).alias("steps")]
    if with_timestamp:
        cols.append(F.lit(_dt.datetime.now(_dt.timezone.utc).isoformat()).alias("processed_at"))
    return nb.crossJoin(na).select(*cols)


def preprocess(df: DataFrame, target: str | None = None, **params) -> tuple[DataFrame, DataFrame, FittedPreprocessor]:
    fitted = Preprocessor(target, **params).fit(df)
    out = fitted.transform(df)
    return out, processing_report(df, out, target), fitted


# X05 / X06 -------------------------------------------------------------------
def prepare_for_model(df: DataFrame, fitted: FittedPreprocessor, expected: Sequence[str],
                      drop_words: Sequence[str] | None = None) -> DataFrame:
    """Score-time preparation: fitted transform (no refit), leak-word drop,
    numeric coercion (null/unparsable -> 0) and alignment to the model's list."""
    from tabloom.operators.schema import LEAK_WORDS, drop_by_keyword, numeric_vector
    out = drop_by_keyword(fitted.transform(df), LEAK_WORDS if drop_words is None else drop_words)
    return numeric_vector(out, expected)


def compatibility(fitted: FittedPreprocessor, expected: Sequence[str]) -> dict[str, list[str]]:
    have = set(fitted.output_columns())
    exp = list(expected)
    return {"missing": [c for c in exp if c not in have],
            "extra": sorted(have - set(exp)),
            "valid": [c for c in exp if c in have]}
