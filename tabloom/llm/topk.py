"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_BLOCK = "dim int, ids binary, vectors binary, norms binary, distances binary"


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x as double, as longs.

    Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part. Components beyond a long count as the nearest long.
    """
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return (table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"))
            .where(finite).select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(2 ** 63 - 1024))), F.lit(-float(2 ** 63)))).cast("long")).alias("v")))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: in doubles where no sum can pass 2^53, in longs
    where none can pass 2^63, else as Python integers."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0 ** 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots that lie far apart: each next one is farthest from those chosen."""
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], axis=1)


def _blocks(pivots, rows: int):
    """Rows packed into blocks of one dimension, with norms and the pivot table."""
    def pack(dim, ids, vectors):
        v = np.array(vectors, dtype=np.int64).reshape(len(ids), dim)
        d = _distances(v.astype(np.float64), pivots.value[dim])
        return (dim, np.array(ids, dtype=np.int64).tobytes(), v.tobytes(), (v.astype(np.float64) ** 2).sum(axis=1).tobytes(), d.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(pack(dim, ids, vectors), [pa.int32()] + 4 * [pa.binary()])],
                                              names=["dim", "ids", "vectors", "norms", "distances"])
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                v = v.values.to_numpy()
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)
    return run


def search_block(qid: int, q: np.ndarray, q_norm: float, q_dist: np.ndarray, floor: int | None, k: int, ids: np.ndarray, x: np.ndarray,
                 norms: np.ndarray, dist: np.ndarray) -> list[tuple[int, int]]:
    """(vec_id, score) of the at most k best rows of a block, ties to smaller ids.

    |d(q,p) - d(x,p)| <= d(q,x) for every pivot p, so the largest difference bounds
    the distance from below and (|q|^2 + |x|^2 - d^2) / 2 the product from above.
    Rows are evaluated by falling bound until the next bound is below the k-th best
    score (or ``floor``, a score that k rows are known to reach): nothing after it
    can enter. The bound is widened by 1e-9 of its terms against rounding.
    """
    low = np.abs(dist - q_dist).max(axis=1)
    reach = (float(q_norm) + norms - low * low) / 2 + 1e-9 * (float(q_norm) + norms + low * low) + 1
    alive = ids != qid
    if floor is not None:
        alive &= reach >= floor
    order = np.flatnonzero(alive)
    order = order[np.argsort(-reach[order], kind="stable")]
    best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, step = 0, max(64, 4 * k)
    while at < len(order):
        if len(best) == k and reach[order[at]] < best[-1]:
            break
        some = order[at:at + step]
        best_ids, best = np.concatenate((best_ids, ids[some])), np.concatenate((best, _inner(x[some], q[None, :])[:, 0]))
        top = (np.lexsort((best_ids, -best))[:k] if best.dtype != object else
               sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k])
        best_ids, best = best_ids[top], best[top]
        at, step = at + step, 2 * step
    return list(zip(best_ids.tolist(), best.tolist()))


def _search(k: int, sample):
    def unpack(r, side):
        dim = r["dim"]
        v = np.frombuffer(r[f"{side}vectors"], dtype=np.int64).reshape(-1, dim)
        return (np.frombuffer(r[f"{side}ids"], dtype=np.int64), v, np.frombuffer(r[f"{side}norms"], dtype=np.float64),
                np.frombuffer(r[f"{side}distances"], dtype=np.float64).reshape(len(v), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist()):
                if r["dim"] != r["q_dim"]:
                    continue
                ids, x, norms, dist = unpack(r, "")
                q_ids, q, q_norms, q_dist = unpack(r, "q_")
                seen_ids, seen = sample.value[r["dim"]]
                known = _inner(q, seen)
                out = []
                for i, qid in enumerate(q_ids.tolist()):
                    reached = np.sort(known[i][seen_ids != qid])
                    floor = int(reached[-k]) if len(reached) >= k else None
                    out += [(qid, v, s) for v, s in search_block(qid, q[i], float(q_norms[i]), q_dist[i], floor, k, ids, x, norms, dist)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.decimal128(38, 0)))],
                                                     names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, sample: int = 512, block: int = 4096,
          query_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every
    query with all rows but those of its own id, exactly; ties go to the smaller id.

    ``vectors`` holds (vec_id, v: array of longs). Pivots come from a bounded sample
    (the ``sample`` rows smallest by hash of each dimension): they only steer the
    order of work. Distances to them are computed once a row and kept in blocks;
    query blocks meet candidate blocks as a stated query set against all rows.
    Vectors of different dimensions have no product and never meet. Scores rank by
    their exact value; one beyond a long is returned as the nearest long. Queries with
    the same id count once; fewer than k candidates give all; no vectors, no rows.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.withColumn("dim", F.size("v")))
    first = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    seeds: dict[int, list] = {}
    for r in rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("dim", "vec_id", "v").collect():
        seeds.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
    known = {d: (np.array([i for i, _ in s], dtype=np.int64), np.array([v for _, v in s], dtype=np.int64)) for d, s in seeds.items()}
    sc = spark.sparkContext
    pivot_rows = sc.broadcast({d: choose_pivots(v.astype(np.float64), pivots) for d, (_, v) in known.items()})
    candidates = stage(rows.mapInArrow(_blocks(pivot_rows, block), _BLOCK))
    asked = rows.where(is_query).dropDuplicates(["vec_id"]).mapInArrow(_blocks(pivot_rows, query_block), _BLOCK)
    asked = stage(asked.select([F.col(c).alias(f"q_{c}") for c in asked.columns]))
    found = candidates.crossJoin(asked).mapInArrow(_search(k, sc.broadcast(known)), "query_id long, vec_id long, score decimal(38,0)")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    long = F.greatest(F.least("score", F.lit(2 ** 63 - 1).cast("decimal(38,0)")), F.lit(-2 ** 63).cast("decimal(38,0)")).cast("long")
    return (found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", long.alias("score")))
