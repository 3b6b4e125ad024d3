"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import checkpoint_dir, materialize as stage  # noqa: F401  (re-exported)


def text_or_empty(col: str = "text") -> Column:
    """The column as text; null counts as the empty text."""
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def utf8(col: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return text_or_empty(col).cast("binary")


def free_name(taken, base: str) -> str:
    """``base``, with underscores before it until it isn't one of ``taken`` (any case)."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base = f"_{base}"
    return base


def new_folder(spark, name: str) -> str:
    """A fresh folder name below the shared folder that all executors see."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_filesystem(uri: str):
    """(filesystem, path) that opens files of the shared folder from any task.

    Works for every scheme pyarrow knows (file, hdfs, s3, gs, abfss); plain
    paths are local mounts that the cluster shares.
    """
    from pyarrow import fs
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def hand_back() -> None:
    """Return a Python worker's freed memory to the system, so that idle and reused
    workers of an executor don't add up."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


class Memo(dict):
    """A bounded memo: emptied when it is full, so a task's memory stays flat."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def make_room(self, coming: int) -> None:
        if len(self) + coming > self.limit:
            self.clear()


class HashSet64:
    """A bit table of fixed size that tells whether a 64-bit hash may be in a set.

    It answers "maybe" or "surely not"; its size never grows with the data (8 MB
    at 26 bits), so it may be broadcast. A fuller table only answers "maybe" more
    often: whatever passes is settled by an exact join afterwards.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, df: DataFrame, col: str, bits: int = 26) -> "HashSet64":
        """Build from a long column: one bit_or aggregate, at most 2^(bits-6) rows back."""
        slot = F.col(col).bitwiseAND(F.lit((1 << bits) - 1))
        # 6 low bits choose the bit in a word, the others the word
        rows = (df.where(F.col(col).isNotNull())
                .select(F.shiftright(slot, 6).alias("word"),
                        F.expr(f"shiftleft(1L, cast({col} & 63 as int))").alias("bit"))
                .groupBy("word").agg(F.bit_or("bit").alias("set")).toPandas())
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[rows["word"].to_numpy(dtype=np.int64)] = rows["set"].to_numpy(dtype=np.int64).view(np.uint64)
        return cls(words, bits)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
