"""Operators of a training-data pipeline (archives, tokens, chat windows,
decontamination, quality, scoring, search, near-duplicates, shards).

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; per-row Python runs as Arrow batches inside tasks.
"""
