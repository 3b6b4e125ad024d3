"""Top a small sample up with the categories that only the full table has."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabloom.operators.augment import category_coverage, cover_categories
from tabloom.operators.schema import drop_duplicate_columns
from tabloom.plans.preprocess import FittedPreprocessor, Preprocessor
from tabloom.session import materialize


@dataclass
class Enhanced:
    rows: DataFrame            # cleaned sample with the rows added
    encoded: DataFrame         # the same, encoded by the plan fitted on the full table
    added: DataFrame           # the rows added
    coverage: DataFrame        # (column, n_before, n_after, n_new)
    plan: FittedPreprocessor


def enhance(sample: DataFrame, full: DataFrame, cols: Sequence[str], key: str, target: str | None = None, n: int = 5,
            exclude: Sequence[str] = (), seed: int = 42, **params) -> Enhanced:
    """Clean both sides with one plan, add ``n`` rows of ``full`` for every category of
    ``cols`` that the sample lacks, and encode the result.

    The plan (names, fills, tidy values, mapping; ``params`` go to ``Preprocessor``)
    is fitted on the full table, so spellings that it makes equal are one category
    on both sides. ``cols``, ``key`` and ``exclude`` are cleaned column names.
    Excluded columns take part in no top-up, but an added row may not bring them a
    new level. Columns that encoding doubles are dropped.
    """
    plan = Preprocessor(target, **params).fit(full)

    def cleaned(df):
        return materialize(plan._clean(plan._names(df)))
    before = cleaned(sample)
    after, added = cover_categories(before, cleaned(full), cols, key, n, exclude, seed)
    after = materialize(after)
    return Enhanced(after, drop_duplicate_columns(plan._encode(after)), added, category_coverage(before, after, cols), plan)
