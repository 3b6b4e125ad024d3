"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, utf8
from .components import connected_components

BITS = 64
SEED = 42
_BLOCK = 1 << 16          # shingles whose bits are counted at once: 4 MB, whatever the text's length


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text: words are runs of bytes other than ASCII white
    space, A-Z lower-cased; a bit is set if over half of the shingle hashes have it.

    Shingles are counted with repeats. Fewer words than a shingle holds: the whole
    sequence is the only shingle. No word at all: zero.
    """
    from xxhash import xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()[: len(words) - shingle + 1]
    ends = (ends[shingle - 1:] - 1).tolist()
    n, votes = len(starts), np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _BLOCK):
        hashes = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[k:k + _BLOCK], ends[k:k + _BLOCK])],
                          dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
        for part in np.split(bits, range(255, len(bits), 255)):       # 255 ones still fit a byte
            votes += part.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > n).view(">u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; null texts count as empty."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
            .mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))


def _variants(prints: DataFrame, max_distance: int) -> DataFrame:
    """(key, fp, pos): every segment of a fingerprint with one bit as a wildcard."""
    segments = max_distance // 2 + 1            # so many that one segment differs in at most one bit
    width = -(-BITS // segments)
    s, p = F.col("segment"), F.col("pos")
    return (prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
            .select("fp", "segment",
                    F.expr(f"shiftrightunsigned(fp, segment * {width}) & {(1 << width) - 1}L" if segments > 1 else "fp")
                    .alias("part"),
                    F.expr(f"least({width}, {BITS} - segment * {width})").alias("width"))
            .select("fp", "segment", "part", F.expr("explode(sequence(0, width - 1))").alias("pos"))
            .select(F.expr("part & ~shiftleft(1L, pos)").alias("part"),
                    (s * BITS + p).cast("int").alias("slot"), "fp",
                    F.expr("(part & shiftleft(1L, pos)) <> 0").alias("bit"), "pos"))


def links(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints that differ in at most
    ``max_distance`` bits.

    A pair meets in a segment that differs in at most one bit, under the wildcard
    of that bit (under the first one, if the segment is equal): so once a segment.
    Both sides name the same columns, so that one shuffle serves both.
    """
    v = _variants(prints, max_distance)
    a, b = v.alias("a").hint("merge"), v.alias("b")       # an estimate doesn't see that rows were multiplied
    return (a.join(b, F.expr("a.part = b.part and a.slot = b.slot and a.fp < b.fp"
                             " and (a.bit <> b.bit or a.pos + b.pos = 0)"
                             f" and bit_count(a.fp ^ b.fp) <= {max_distance}"))
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest doc_id reached
    over links of at most ``max_distance`` differing bits (itself included).
    Equal fingerprints are one node, so copies never meet in pairs. Null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows come
    back repeated; rows without doc_id belong to a component but never name it.
    Further columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, shingle))
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stage(connected_components(links(nodes.select("fp"), max_distance)))
    named = (nodes.join(roots, nodes.fp == roots.node, "left")
             .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return (rows.join(by_print, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, all columns as
    they are. A doc_id names one document: rows that repeat it are copies, and one
    of them stays. Rows without doc_id stay (nothing names them)."""
    found = stage(near_duplicates(docs, shingle, max_distance).where("doc_id is not null").select("doc_id", "component_id"))
    lost = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct())
    again = stage(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id"))
    kept = docs.join(lost, F.col("doc_id") == F.col("__id"), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, F.col("doc_id") == F.col("__id"), "left_anti")
    return once.unionByName(kept.join(again, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"]))
