"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the spectrum of what it has read: a number of rows, their mean, and the eigenvalues and vectors of
their scatter. New rows enter by centred rank-one updates, each of which solves a secular equation after
deflation. Spectra of two tasks combine in the same way: the scaled eigenvectors of one and the difference of the means are
rank-one updates of the other. They combine in rounds, a bounded number per task. The spectrum of all rows is a basis, in which
a last pass over the rows takes the covariance (Rayleigh-Ritz); its small eigenproblem gives the components to
double precision.

The rows of a block enter through the triangular factor of the block: it has the same scatter and as many rows as dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import stored

#: Components that are returned at most.
COMPONENTS = 32
#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: A row with an entry of this size or more takes no part, as its fixed-point form is not exact in a double.
LARGEST = 2.0 ** 46
#: Values of a block of rows, and spectra that one task combines.
BLOCK = 1 << 18
FAN = 32

_EPS = np.finfo(float).eps


# --- one rank-one update ------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z: np.ndarray, rho: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z_j^2 / (d_j - x)), one above each pole ``d`` (ascending, distinct; no z is zero).

    Given as the nearest pole's index and the distance from it, so that differences to poles lose no digits. All roots are
    refined at once: interpolation with two poles, held within a bracket that halves where a step leaves it.
    """
    k = len(d)
    w = rho * z * z
    upper = np.append(d[1:], d[-1] + 2 * w.sum())
    index = np.arange(k)
    middle = (upper - d) / 2
    # The sign at the middle tells which pole is nearer; the last root is told from its own pole.
    at_middle = 1 + (w / (d - d[:, None] - middle[:, None])).sum(axis=1)
    near = np.where((at_middle < 0) & (index < k - 1), index + 1, index)
    origin = d[near]
    gaps = d[None, :] - origin[:, None]
    low = np.where(near > index, -middle, 0.0)
    high = np.where(near > index, 0.0, middle)
    last_low = at_middle[-1] < 0
    low[-1], high[-1] = (middle[-1], upper[-1] - d[-1]) if last_low else (0.0, middle[-1])
    x = (low + high) / 2
    below = index[None, :] <= index[:, None]
    left_gap, right_gap = d - origin, upper - origin
    for _ in range(rounds):
        delta = gaps - x[:, None]
        terms = w / delta
        f = 1 + terms.sum(axis=1)
        slopes = terms / delta
        slope = slopes.sum(axis=1)
        # What f may be wrong by: rounding of its terms, and of x.
        done = np.abs(f) <= _EPS * (8 + 8 * np.abs(terms).sum(axis=1) + np.abs(x) * slope)
        if done.all():
            break
        # f rises from pole to pole.
        low = np.where(f < 0, x, low)
        high = np.where(f >= 0, x, high)
        psi = np.where(below, slopes, 0).sum(axis=1)
        phi = slope - psi
        dl, dr = left_gap - x, right_gap - x
        a = (dl + dr) * f - dl * dr * slope
        b = dl * dr * f
        c = f - dl * psi - dr * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        x = np.where(done | (new == 0), x, new)
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors (columns) of vectors * diag(values) * vectors' + v v'."""
    norm = float(np.sqrt(v @ v))
    if norm == 0:
        return values, vectors
    z = vectors.T @ (v / norm)
    rho = norm * norm
    tolerance = 8 * _EPS * max(float(np.abs(values).max()), rho)
    # Deflation: of equal eigenvalues a reflection leaves one with a part in v, and small parts are none.
    vectors = vectors.copy()
    starts = [0, *(np.flatnonzero(np.diff(values) > tolerance) + 1), len(values)]
    for start, stop in zip(starts, starts[1:], strict=False):
        if stop - start > 1:
            mirror = z[start:stop].copy()
            length = np.copysign(np.sqrt(mirror @ mirror), mirror[-1])
            if length == 0:
                continue
            mirror[-1] += length
            vectors[:, start:stop] -= np.outer(vectors[:, start:stop] @ mirror, mirror * (2 / (mirror @ mirror)))
            z[start:stop] = 0
            z[stop - 1] = -length
    active = np.flatnonzero(rho * np.abs(z) > tolerance)
    if not len(active):
        return values, vectors
    d = values[active]
    near, x = secular_roots(d, z[active], rho)
    found = d[near] + x
    gaps = (d[None, :] - d[near][:, None]) - x[:, None]  # pole - root, root by row
    # The parts of v for which these roots are exact give orthogonal vectors.
    k = len(d)
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    ratio = gaps / np.where(np.eye(k, dtype=bool), 1.0, apart)
    exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), z[active])
    turn = exact[:, None] / gaps.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    vectors[:, active] = vectors[:, active] @ turn
    values = values.copy()
    values[active] = found
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


# --- spectra ------------------------------------------------------------------------------------------

@dataclass
class Spectrum:
    """Rows, their sums (exact), and eigenvalues and vectors of their scatter around their mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimensions: int) -> Spectrum:
        return cls(0, [0] * dimensions, np.zeros(dimensions), np.eye(dimensions))

    def _take(self, updates: np.ndarray, n: int, sums: list[int]) -> None:
        """Rank-one updates with the rows of ``updates``, and with the difference of the means of both sides."""
        if self.n and n:
            apart = np.array([(s * self.n - t * n) / (self.n * n) for s, t in zip(sums, self.sums, strict=True)])
            updates = np.vstack([updates, apart * np.sqrt(self.n / (self.n + n) * n)])
        for v in updates:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.n += n
        self.sums = [s + t for s, t in zip(self.sums, sums, strict=True)]

    def add_rows(self, x: np.ndarray) -> None:
        """Rows of long entries."""
        first = x[0]
        apart = (x - first).astype(float)  # whole numbers, as small as the spread
        centred = apart - apart.mean(axis=0)
        rows = np.linalg.qr(centred, mode="r") if len(centred) > x.shape[1] else centred
        total = (x - first).astype(object).sum(axis=0) if _wide(x - first) else (x - first).sum(axis=0)
        self._take(rows, len(x), [int(t) + len(x) * int(f) for t, f in zip(total, first, strict=True)])

    def add(self, other: Spectrum) -> None:
        self._take((other.vectors * np.sqrt(np.maximum(other.values, 0))).T, other.n, other.sums)


def _wide(x: np.ndarray) -> bool:
    """Whether sums of ``x`` may leave a long."""
    return float(np.abs(x.astype(float)).max(initial=0)) * len(x) >= 2.0 ** 62


# --- passes over the rows -------------------------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v`` (doubles) of the rows that take part, and no others.

    A vector that is null or empty, holds an entry that is null, not finite or too large for exact arithmetic
    (``LARGEST``), takes no part. Vectors must be of one length: that of most rows, the shortest of several.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)), F.lit(False))
    rows = vectors.select("vec_id", v.alias("v")).where(fine & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def _fixed(column: pa.ListArray, dimensions: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.floor(values * SCALE).astype(np.int64) + OFFSET


def _blocks(batches, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    size = max(1, BLOCK // dimensions)
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part, _fixed(part.column("v"), dimensions)


def _merged(parts: DataFrame, read: Callable, write: Callable, name: str) -> list:
    """Partial results combined in rounds, at most ``FAN`` in one task at a time; the driver gets one.

    ``parts`` has ``part`` and binary columns; ``read`` makes an object with ``add`` of a row, ``write`` a row of it.
    """
    schema = parts.schema
    names = schema.names[1:]
    parts = stored(parts, name)
    while (n := parts.count()) > 1:
        def combine(batches, n=n) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["part"] != at:
                        if held is not None:
                            yield record(at, held)
                        at, held = row["part"], read(row)
                    else:
                        held.add(read(row))
            if held is not None:
                yield record(at, held)

        def record(at, held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([b], pa.binary()) for b in write(held))],
                                              names=["part", *names])

        # Parts are numbered without gaps, so groups are full and each round divides their number by FAN.
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        parts = stored(grouped.repartition("part").sortWithinPartitions("part").mapInArrow(combine, schema), name)
    return [read(r.asDict()) for r in parts.collect()]


def _numbered(rows: DataFrame) -> DataFrame:
    """One row per task, with the task as ``part`` (gapless up to tasks without rows)."""
    return rows.withColumn("part", F.spark_partition_id().cast("long"))


def spectrum(rows: DataFrame, dimensions: int) -> Spectrum | None:
    """The spectrum of all rows of ``usable``; None if there are none."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own, part = Spectrum.empty(dimensions), None
        for batch, x in _blocks(batches, dimensions):
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                own.add_rows(x)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([b], pa.binary()) for b in write(own))],
                                             names=["part", "n", "sums", "values", "vectors"])

    def write(s: Spectrum) -> tuple[bytes, ...]:
        return (str(s.n).encode(), " ".join(map(str, s.sums)).encode(), s.values.tobytes(), s.vectors.tobytes())

    def read(row: dict) -> Spectrum:
        return Spectrum(int(row["n"]), [int(s) for s in row["sums"].split()], np.frombuffer(row["values"]),
                        np.frombuffer(row["vectors"]).reshape(dimensions, dimensions))

    parts = _numbered(rows).select("part", "v").mapInArrow(run, "part long, n binary, sums binary, values binary, vectors binary")
    found = _merged(parts, read, write, "spectra")
    return found[0] if found else None


@dataclass
class _Moments:
    """Sums of rows and of their outer products."""

    first: np.ndarray
    second: np.ndarray

    def add(self, other: _Moments) -> None:
        self.first = self.first + other.first
        self.second = self.second + other.second


def moments(rows: DataFrame, dimensions: int, project: Callable[[np.ndarray], np.ndarray], width: int) -> _Moments:
    """Sums and sums of outer products of ``project`` of the long rows."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own, part = _Moments(np.zeros(width), np.zeros((width, width))), None
        for batch, x in _blocks(batches, dimensions):
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                y = project(x)
                own.add(_Moments(y.sum(axis=0), y.T @ y))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([b], pa.binary()) for b in write(own))],
                                             names=["part", "first", "second"])

    def write(m: _Moments) -> tuple[bytes, ...]:
        return m.first.tobytes(), m.second.tobytes()

    def read(row: dict) -> _Moments:
        return _Moments(np.frombuffer(row["first"]), np.frombuffer(row["second"]).reshape(width, width))

    parts = _numbered(rows).select("part", "v").mapInArrow(run, "part long, first binary, second binary")
    return _merged(parts, read, write, "moments")[0]


@dataclass(frozen=True)
class Whitening:
    """What whitens: n, exact sums, eigenvalues (falling) with components in rows, the trace, and the largest error."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n by whole numbers, rounded once."""
        return scaled(x, self.n, self.sums) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, as longs where they fit, else as Python's whole numbers."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most < 1 << 63:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n*x - S)^2; None where it is no long."""
    apart = scaled(x, n, sums)
    most = int(np.abs(apart).max(initial=0))
    squares = apart if most * most * x.shape[1] < 1 << 63 else apart.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (squares * squares).sum(axis=1)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows of ``usable``; None if there are none.

    Components whose eigenvalue is zero but for rounding have no whitened form and are left out. Signs are such that the
    largest entry of a component is positive. The driver holds matrices of dimensions x dimensions.
    """
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return None
    dimensions = first["d"]
    coarse = spectrum(rows, dimensions)
    n, sums, basis = coarse.n, coarse.sums, coarse.vectors[:, ::-1].copy()
    ritz = moments(rows, dimensions, lambda x: (scaled(x, n, sums) / n).astype(float) @ basis, dimensions)
    covariance = ritz.second / n
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, found = values[order], (basis @ turn[:, order]).T
    trace = float(np.trace(covariance))
    keep = min(components, int((values > 64 * _EPS * dimensions * max(trace, 0.0)).sum()))
    found = found[:keep]
    found = found * np.sign(np.take_along_axis(found, np.abs(found).argmax(axis=1)[:, None], 1)) if keep else found
    model = Whitening(n, sums, values[:keep], found, trace, 0.0)
    if not keep:
        return model
    white = moments(rows, dimensions, lambda x: model.apply(x).astype(float), keep)
    mean = white.first / n
    error = float(np.abs(white.second / n - np.outer(mean, mean) - np.eye(keep)).max())
    return Whitening(n, sums, model.values, found, trace, error)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    Which rows take part says ``usable``; of those every one does, repeated rows and rows without an id too. There are
    ``components`` components at most, fewer if there are fewer dimensions or if the rows do not spread in so many; none, and so no
    row, for an empty table or where all vectors are equal. deviation is null where it is no long. Other columns are ignored.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    model = fit(rows, components)
    keep = len(model.values) if model else 0
    if not keep:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.values / m.trace
        for batch, x in _blocks(batches, m.components.shape[1]):
            if not batch.num_rows:
                continue
            count = batch.num_rows
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), keep)))
            every = pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(count), keep)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), count)), pa.array(np.full(count * keep, m.n)), every,
                 pa.array(m.apply(x).astype(float).ravel()), pa.array(np.tile(explained, count)),
                 pa.array(np.full(count * keep, m.error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
