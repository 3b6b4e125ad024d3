"""Registry of operator queries: a Spark callable and (where SQL can express it)
the equivalent DuckDB SQL, keyed by the SURVEY §2 id (``a05_...``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (distributed sums differ in the last bits)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def round_cols(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round only the named columns (noisy aggregates); exact values stay exact."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits else F.col(f"`{c}`")
                       for c in df.columns])


def load_all() -> None:
    """Import every suite module so their queries register."""
    from tabloom.plans import (suite_core, suite_text, suite_profile, suite_multivalue,  # noqa: F401
                               suite_encode, suite_augment, suite_models, suite_synth, suite_stream,
                               suite_plan, suite_profile2)
