"""Embedding whitening by an incremental eigendecomposition.

Tasks update the spectrum of their vectors' scatter one vector at a time (a centred
rank-one update by the secular equation), spectra are merged pairwise by the same
update, and a Rayleigh-Ritz pass over all vectors makes the result exact to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage

_EPS = np.finfo(np.float64).eps
_REACH = float(1 << 62)          # entries beyond this count as this
_CELLS = 1 << 20                 # matrix cells of vectors handled at once


# ---- one rank-one update

def _clusters(values: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Runs [a, b) of at least two ascending values that are equal within tolerance."""
    out, a = [], 0
    close = np.flatnonzero(np.diff(values) <= tolerance)
    if not len(close):
        return out
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] - values[a] > tolerance:
            if k - a > 1:
                out.append((a, k))
            a = k
    return out


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(poles) + z z^T and the matrix [k, i] of poles[i] - root k.

    ``poles`` ascend strictly and no z is zero, so root k lies between pole k and the
    next one (the last within |z|^2 of its pole) and solves 1 + sum z_i^2 / (pole_i -
    root) = 0. Each root is counted from its nearer pole, so differences keep all
    digits. Steps fit one hyperbola to the poles on either side; a step that leaves
    the bracket is a bisection.
    """
    n, w = len(poles), z * z
    ends = np.append(poles[1:], poles[-1] + w.sum())
    middle = (poles + ends) / 2
    left = 1 + (w / (poles - middle[:, None])).sum(axis=1) > 0          # f grows: the root is left of the middle
    left[-1] = True
    origin = np.where(left, poles, ends)
    gaps = poles - origin[:, None]                                      # [k, i], exact where it matters
    near, far = poles - origin, ends - origin
    half = (ends - poles) / 2
    low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    high[-1] = far[-1]
    root = (low + high) / 2
    at_most = np.tri(n, dtype=bool)                                     # poles up to the root's own
    for _ in range(100):
        away = gaps - root[:, None]
        terms = w / away
        steep = terms / away
        f = 1 + terms.sum(axis=1)
        done = np.abs(f) <= 4 * _EPS * n * (1 + np.abs(terms).sum(axis=1))
        done |= (high - low) <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        low, high = np.where(f <= 0, root, low), np.where(f >= 0, root, high)
        below = np.where(at_most, steep, 0.0).sum(axis=1)
        above = steep.sum(axis=1) - below
        x, y = near - root, far - root
        a, b, c = (x + y) * f - x * y * (below + above), x * y * f, f - x * below - y * above
        with np.errstate(all="ignore"):
            s = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - s) / (2 * c), 2 * b / (a + s))
            new = root + step
            bad = ~((new > low) & (new < high))
        root = np.where(done, root, np.where(bad, (low + high) / 2, new))
    return origin + root, gaps - root[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of vectors diag(values) vectors^T + x x^T; values ascend.

    Deflation: where eigenvalues are equal to rounding, their vectors are turned (one
    reflection) so that only one of them meets x; directions that x doesn't meet to
    rounding keep their pairs. The rest solves the secular equation; vectors come
    from the update that has exactly the computed roots, so they stay orthogonal.
    """
    z = vectors.T @ x
    size = max(abs(values[-1]), abs(values[0]), float(z @ z))
    if size == 0.0:
        return values, vectors
    tolerance = 8 * _EPS * size
    vectors = vectors.copy()
    for a, b in _clusters(values, tolerance):
        part = z[a:b].copy()
        length = np.linalg.norm(part)
        if length * np.sqrt(size) <= tolerance:
            continue
        mirror = part.copy()
        mirror[-1] += np.copysign(length, part[-1])
        mirror /= np.linalg.norm(mirror)
        vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ mirror, mirror)
        z[a:b] = 0.0
        z[b - 1] = -np.copysign(length, part[-1])
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
    if not len(live):
        return values, vectors
    poles, z = values[live], z[live]
    roots, away = secular_roots(poles, z)
    n = len(live)
    # z^ has the computed roots exactly: z_i^2 = (root_n - p_i) prod (root_k - p_i) / (p_k or p_k+1 - p_i)
    apart = poles[:, None] - poles                                       # [k, i]
    top = -away[:-1]                                                     # [k, i] of root_k - p_i, without the last root
    under = np.where(np.arange(n - 1)[:, None] < np.arange(n), apart[:-1], apart[1:])
    exact = np.sqrt(np.abs(-away[-1] * np.prod(top / under, axis=0)))
    turn = np.copysign(exact, z) / away                                  # [k, i]
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    values = values.copy()
    values[live], vectors[:, live] = roots, vectors[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, exact sums, and eigenpairs of the centred scatter of some vectors."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, np.zeros(dim, dtype=object)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(np.float64)

    def add(self, rows: np.ndarray) -> None:
        """Centred rank-one update for each row (of longs)."""
        exact = self.sums.copy()
        for start in range(0, len(rows), 4096):
            part = rows[start:start + 4096]
            wide = np.abs(part).max(initial=0) < 1 << 50
            # running means: sums so far, exact in int64 for a part of 4096 such rows
            before = np.cumsum(part, axis=0) - part if wide else np.cumsum(part.astype(object), axis=0) - part
            for x, seen in zip(part, before):
                if self.n:
                    away = x - ((exact + seen) / self.n).astype(np.float64)
                    self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n / (self.n + 1)))
                self.n += 1
            exact = exact + part.astype(object).sum(axis=0)
        self.sums = exact

    def merge(self, other: "Spectrum") -> None:
        """Other's eigenpairs one by one, then the difference of the means."""
        if not other.n:
            return
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)
        away = other.mean() - self.mean()
        self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n * other.n / (self.n + other.n)))
        self.n, self.sums = self.n + other.n, self.sums + other.sums


# ---- Spark side

def _matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    values, starts = column.values.to_numpy(), column.offsets.to_numpy()
    return values[(starts[rows][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows), dim)


def _by_dim(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, vectors) of a batch's rows, some at a time."""
    column = batch.column(name)
    lengths = np.diff(column.offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dim)
        step = max(1, _CELLS // max(dim, 1))
        for k in range(0, len(places), step):
            yield dim, places[k:k + step], _matrix(column, places[k:k + step], dim)


_STATE = "dim int, part long, n long, sums array<string>, values binary, vectors binary"
_STATE_NAMES = ["dim", "part", "n", "sums", "values", "vectors"]
_SUM = "dim int, part long, total binary"
_SUM_NAMES = ["dim", "part", "total"]


def _as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"dim": pa.int32(), "part": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.binary())) for c, k in zip(zip(*rows), names)], names=names)


def _state(dim: int, part: int, s: Spectrum) -> tuple:
    return dim, part, s.n, [str(int(v)) for v in s.sums], s.values.tobytes(), s.vectors.tobytes()


def _spectrum(r: dict) -> Spectrum:
    s = Spectrum(r["dim"])
    s.n, s.sums = r["n"], np.array([int(v) for v in r["sums"]], dtype=object)
    s.values, s.vectors = np.frombuffer(r["values"]).copy(), np.frombuffer(r["vectors"]).reshape(r["dim"], -1).copy()
    return s


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One spectrum a task and dimension."""
    from pyspark import TaskContext
    held: dict[int, Spectrum] = {}
    for batch in batches:
        for dim, _, rows in _by_dim(batch, "x"):
            held.setdefault(dim, Spectrum(dim)).add(rows)
    for dim, s in held.items():
        yield _as_batch([_state(dim, TaskContext.get().partitionId(), s)], _STATE_NAMES)


def _merged(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole = _spectrum(rows[0])
        for r in rows[1:]:
            whole.merge(_spectrum(r))
        return pa.Table.from_batches([_as_batch([_state(rows[0]["dim"], rows[0]["part"] // width, whole)], _STATE_NAMES)])
    return run


def _added(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = np.sum([np.frombuffer(r["total"]) for r in rows], axis=0)
        return pa.Table.from_batches([_as_batch([(rows[0]["dim"], rows[0]["part"] // width, total.tobytes())], _SUM_NAMES)])
    return run


def _tree(parts: DataFrame, merge: Callable, schema: str, width: int) -> list[dict]:
    """Merge the tasks' parts in groups of ``width``, round by round, to one row a dimension."""
    parts = stage(parts)
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        group = F.floor(F.col("part") / width).cast("long").alias("group")
        parts = stage(parts.groupBy("dim", group).applyInArrow(merge(width), schema))
    return [r.asDict() for r in parts.collect()]


def _products(basis):
    """Sum over a task's vectors of (basis^T (x - mean)) times itself, a matrix a dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, rows in _by_dim(batch, "x"):
                mean, columns = basis.value[dim]
                seen = (rows - mean) @ columns
                held[dim] = held.get(dim, 0.0) + seen.T @ seen
        for dim, total in held.items():
            yield _as_batch([(dim, TaskContext.get().partitionId(), total.tobytes())], _SUM_NAMES)
    return run


def shifted_vectors(table: DataFrame, column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The table's rows with ``x``: floor(scale * c) + shift of every entry c as double.

    Rows whose vector is null or holds a null or non-finite entry are dropped, empty
    vectors too (they have no component). Entries whose product lies beyond 2^62
    count as 2^62, so every result is a long. A column named x gives way to this one.
    """
    name = free_name(table.columns, "entries")
    finite = F.forall(name, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    long = lambda c: (F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(_REACH)), F.lit(-_REACH))).cast("long") + F.lit(shift))
    kept = (table.withColumn(name, F.transform(F.col(f"`{column}`"), lambda c: c.cast("double")))
            .where((F.size(name) > 0) & finite))
    return kept.withColumn("x", F.transform(name, long)).drop(name)


def fit_whitening(vectors: DataFrame, components: int = 16, width: int = 8) -> dict[int, dict]:
    """{dim: n, sums, mean, values, columns, explained, identity_error} from the distinct
    vectors ``x`` (arrays of longs) of the table; each length is a space of its own.

    ``columns`` hold the eigenvectors of the covariance (divisor n) for its largest
    ``components`` eigenvalues ``values``, by falling eigenvalue, over the roots of
    these. An eigenvalue of zero, to rounding, can't be divided by: its column is NaN
    and takes no part in ``identity_error``, the largest entry by which the whitened
    covariance differs from the identity (None if all are zero). What a task keeps
    and the driver gets is a few matrices of dim x dim, whatever the number of rows.
    No rows, no spaces.
    """
    sc = vectors.sparkSession.sparkContext
    fit = stage(vectors.select("x").dropDuplicates())
    spectra = {r["dim"]: _spectrum(r) for r in _tree(fit.mapInArrow(_spectra, _STATE), _merged, _STATE, width)}
    # Rayleigh-Ritz: the covariance as the merged basis sees it, over all vectors once more
    bases = {d: (s.mean(), np.linalg.qr(s.vectors)[0]) for d, s in spectra.items()}
    out, whiten = {}, {}
    for r in _tree(fit.mapInArrow(_products(sc.broadcast(bases)), _SUM), _added, _SUM, 8 * width):
        d, s = r["dim"], spectra[r["dim"]]
        seen = np.frombuffer(r["total"]).reshape(d, d) / s.n
        values, turn = np.linalg.eigh((seen + seen.T) / 2)
        values, axes = np.maximum(values[::-1], 0.0), (bases[d][1] @ turn)[:, ::-1]
        zero = values <= d * 4 * _EPS * values[0]
        trace = float(np.trace(seen))
        with np.errstate(all="ignore"):
            columns = np.where(zero, np.nan, axes / np.sqrt(values))[:, :components]
        out[d] = {"n": s.n, "sums": s.sums, "mean": s.mean(), "values": values[:components], "columns": columns,
                  "explained": values[:components] / trace if trace > 0 else np.full(min(components, d), np.nan), "identity_error": None}
        whiten[d] = (s.mean(), np.nan_to_num(columns[:, ~zero[:components]]))
    for r in _tree(fit.mapInArrow(_products(sc.broadcast(whiten)), _SUM), _added, _SUM, 8 * width):
        d, k = r["dim"], whiten[r["dim"]][1].shape[1]
        if k:
            out[d]["identity_error"] = float(np.abs(np.frombuffer(r["total"]).reshape(k, k) / out[d]["n"] - np.eye(k)).max())
    return out


def _deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exactly; None beyond a long."""
    most = n * int(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        away = rows * n - sums.astype(np.int64)
        most = int(np.abs(away).max(initial=0))
        if most * most * rows.shape[1] < 1 << 63:
            return (away * away).sum(axis=1).tolist()
    away = rows.astype(object) * n - sums
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, places, rows in _by_dim(batch, "x"):
                m = model.value[dim]
                white = (rows - m["mean"]) @ m["columns"]
                k, far = white.shape[1], _deviations(rows, m["n"], m["sums"])
                each = np.repeat(np.arange(len(rows)), k)
                nan = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
                size = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(places[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                     pa.array(np.full(size, m["n"], dtype=np.int64)), pa.array(far, pa.int64()).take(pa.array(each)), nan(white.reshape(-1)),
                     nan(np.tile(m["explained"], len(rows))), pa.array([m["identity_error"]] * size, pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(table: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for
    each vector that ``shifted_vectors`` keeps and each of its first components.

    The fit takes each distinct vector once, the result every row, repeats and null
    ids included; further columns are ignored. ``whitened`` is null for a component
    without variance, ``explained`` if there is none at all, ``deviation`` where it
    passes a long. An empty table, or one without a sound vector, gives no rows.
    """
    vectors = shifted_vectors(table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    model = table.sparkSession.sparkContext.broadcast(fit_whitening(vectors, components))
    return vectors.select("vec_id", "x").mapInArrow(_project(model), _WHITE)
