"""Operator 11: embedding whitening with eigenvectors from FEAST contour integration.

1. *Moments.* Entries become whole numbers, each distinct vector counts once. Sums, then the centred
   second moments are added up where the rows lie; only numbers per dimension pair reach the driver.
2. *Slices.* The covariance is brought to tridiagonal form once. Inertia counts (signs of its pivots
   when shifted) tell how many eigenvalues lie above any place, so the wanted end of the spectrum is
   cut into slices at wide gaps, each with a known number of eigenvalues.
3. *Contours.* Every slice is a task of its own: a quadrature over complex shifts ``z`` of solves with
   ``z I - V`` projects random vectors onto the eigenvectors inside a circle around the slice,
   Rayleigh-Ritz extracts them, and the step is repeated until the residuals are at rounding level.
   A slice that finds another number of eigenvalues than its inertia count is an error.
4. *Projection.* Rows are whitened in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import give_back
from faultfold.session import settle

#: Entries are taken in steps of one over this. A constant added to all of them would cancel everywhere.
SCALE = 64
COMPONENTS = 16
#: Eigenvalues of one slice, as far as gaps allow, and places of the quadrature on the upper half circle.
SLICE = 8
NODES = 8
MOST_ROUNDS = 40
#: Tasks that add the sums of all others.
SUMS = 16
#: Eigenvalues below this share of the largest count as zero; there is nothing to divide by.
LEAST_SHARE = 1e-12
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def pack(vectors: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, each in the narrowest width that holds it: equal rows, equal bytes."""
    if not vectors.shape[1]:
        return [b""] * len(vectors)
    high, low = vectors.max(axis=1), vectors.min(axis=1)
    out: list[bytes] = [b""] * len(vectors)
    left = np.ones(len(vectors), bool)
    for code, kind in enumerate(_WIDTHS):
        span = np.iinfo(kind)
        fits = left & (high <= span.max) & (low >= span.min)
        for i, row in zip(np.flatnonzero(fits).tolist(), vectors[fits].astype(kind), strict=True):
            out[i] = bytes([code]) + row.tobytes()
        left &= ~fits
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, _WIDTHS[row[0]], dim, 1)
    return out


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, x): rows whose vector has only finite components; x packs ``floor(64 c)``."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null").where(fine)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            entries = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            packed: list[bytes] = [b""] * len(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                for i, x in zip(at.tolist(), pack(entries[starts[at][:, None] + np.arange(dim)]), strict=True):
                    packed[i] = x
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lengths, pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "x"]
            )

    return rows.mapInArrow(run, "id long, dim int, x binary")


def added_up(rows: DataFrame, dim: int, terms) -> np.ndarray:
    """The sum over all rows of what ``terms(matrix)`` makes of a batch.

    Each task has one vector of sums. ``SUMS`` tasks add those of all others, and the driver adds theirs.
    """
    kind = terms(np.zeros((1, dim), np.int64)).dtype

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for a in range(0, part.num_rows, 4096):
                own = terms(unpack(part.column("x").slice(a, 4096).to_pylist(), dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for x in part.column("sums"):
                own = np.frombuffer(x.as_py(), kind)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = rows.select("x").mapInArrow(run, "sums binary").repartition(SUMS).mapInArrow(add, "sums binary").collect()
    return sum(np.frombuffer(bytes(r["sums"]), kind) for r in found)


def covariance(rows: DataFrame, dim: int, n: int, change=None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, covariance) of the rows after ``change``, centred before multiplying, divisor ``n``."""
    change = change or (lambda x: x)
    size = change(np.zeros((1, dim), np.int64)).shape[1]
    sums = added_up(rows, dim, lambda x: change(x).sum(axis=0))
    upper = np.triu_indices(size)
    mean = sums / n

    def second(x: np.ndarray) -> np.ndarray:
        centred = change(x) - mean
        return (centred.T @ centred)[upper]

    flat = added_up(rows, dim, second) / n
    v = np.zeros((size, size))
    v[upper] = flat
    return sums, v + np.triu(v, 1).T


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to ``v`` (Householder steps)."""
    a = np.array(v, np.float64)
    n = len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 1):
        x = a[k + 1 :, k].copy()
        length = float(np.linalg.norm(x))
        off[k] = -length if x[0] > 0 else length
        x[0] -= off[k]
        size = float(np.linalg.norm(x))
        if size > 0:
            u = x / size
            sub = a[k + 1 :, k + 1 :]
            p = sub @ u
            w = p - (u @ p) * u
            sub -= 2 * (np.outer(u, w) + np.outer(w, u))
    return np.diag(a).copy(), off


def below(shape: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues lie below each place, by the signs of the pivots."""
    diagonal, off = shape
    places = np.asarray(places, np.float64)
    least = np.finfo(float).eps * max(1e-300, float(np.abs(diagonal).max(initial=0)))
    pivot = np.ones_like(places)
    count = np.zeros(len(places), np.int64)
    for k, d in enumerate(diagonal):
        pivot = d - places - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def slices(shape: tuple[np.ndarray, np.ndarray], most: int = COMPONENTS, size: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside): the ``most`` largest eigenvalues, in pieces cut at wide gaps.

    Bisection over inertia counts tells where eigenvalues are, well enough to choose cuts. A piece is
    cut on while it has more than ``size`` eigenvalues or comes too near to a neighbour for its width.
    The last may reach below the wanted ones to end in a gap. Eigenvalues that are zero are left out.
    """
    diagonal, off = shape
    n = len(diagonal)
    reach = np.abs(np.concatenate((off, [0]))) + np.abs(np.concatenate(([0], off)))[:n]
    top, bottom = float((diagonal + reach).max(initial=0)), float((diagonal - reach).min(initial=0))
    spread = max(top - bottom, abs(top))
    if not n or top <= 0:
        return []
    top += 1e-3 * spread
    wanted = np.arange(n, max(0, n - most - size), -1)  # the j-th smallest, from the largest down
    low, high = np.full(len(wanted), bottom - 1e-3 * spread), np.full(len(wanted), top)
    for _ in range(50):
        middle = (low + high) / 2
        here = below(shape, middle) >= wanted
        high, low = np.where(here, middle, high), np.where(here, low, middle)
    values = high
    live = int((values > LEAST_SHARE * values[0]).sum()) if values[0] > 0 else 0
    if not live:
        return []
    after = np.append(values[1:], bottom - 1e-3 * spread if len(values) == n else 2 * values[-1] - values[0])
    gaps = values - after
    # Narrower gaps cannot be told from rounding.
    least = 1e-13 * top

    def ends(i: int, j: int) -> tuple[float, float, float]:
        """A circle around eigenvalues i to j that keeps away from its neighbours, and its narrower rim."""
        width = values[i] - values[j]
        above, under = gaps[i - 1] / 2 if i else np.inf, gaps[j] / 2
        rims = min(above, max(width, min(above, under))), min(under, max(width, min(above, under)))
        return values[j] - rims[1], values[i] + rims[0], min(rims)

    def cut(i: int, j: int) -> list[tuple[int, int]]:
        low, high, rim = ends(i, j)
        if i < j and (j - i >= size or rim < 0.05 * (high - low)):
            k = i + int(gaps[i:j].argmax())
            if gaps[k] > least:
                return cut(i, k) + cut(k + 1, j)
        return [(i, j)]

    last = max(range(min(most, live) - 1, live), key=lambda j: gaps[j])
    found = [ends(i, j)[:2] for i, j in cut(0, last)]
    counts = [below(shape, np.array(pair)) for pair in found]
    pieces = [(float(low), float(high), int(c[1] - c[0])) for (low, high), c in zip(found, counts, strict=True)]
    # Inertia once more: nothing lies between the pieces or above them.
    if sum(c for _, _, c in pieces) != n - int(counts[-1][0]):
        raise RuntimeError("eigenvalues between the slices")
    return pieces


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of symmetric ``v`` between ``low`` and ``high``, falling.

    ``count`` is how many there are by inertia; anything else is an error.
    """
    n = len(v)
    norm = float(np.linalg.norm(v, 2)) or 1.0
    columns = min(n, count + max(4, count))
    middle, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (at + 1))
    q = np.random.default_rng(seed).standard_normal((n, columns))
    best = np.inf
    for _ in range(MOST_ROUNDS):
        projected = np.zeros((n, columns))
        for z, w in zip(turn, weight, strict=True):
            solved = np.linalg.solve((middle + radius * z) * np.eye(n) - v, q.astype(complex))
            projected += (w / 2) * (radius * z * solved).real
        basis, _ = np.linalg.qr(projected)
        # Twice is enough: what the contour keeps may be far smaller than what it started from.
        basis, _ = np.linalg.qr(basis)
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        q = basis @ small
        inside = np.flatnonzero((values > low) & (values < high))
        errors = np.linalg.norm(v @ q[:, inside] - q[:, inside] * values[inside], axis=0) / norm
        # A mixture of vectors from both sides may have its value inside, but never converges.
        rank = np.argsort(errors, kind="stable")
        if len(inside) >= count:
            worst = float(errors[rank[count - 1]])
            # Rounding level, or no longer getting better.
            if worst < 4e-15 or (worst < 1e-12 and worst > best / 2):
                if (errors[rank[count:]] * norm < 1e-3 * radius).any():
                    break
                own = np.sort(inside[rank[:count]])[::-1]
                return values[own], q[:, own]
            best = min(best, worst)
    raise RuntimeError(f"not {count} eigenvalues, as inertia says, between {low} and {high}")


def eigenpairs(spark, v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above zero and their vectors, a task for each slice.

    ``v`` goes to the tasks with their code: its size is that of the dimensions, not of the table.
    """
    cut = slices(tridiagonal(v), most)
    if not cut:
        return np.empty(0), np.empty((len(v), 0))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                values, vectors = feast(v, row["low"], row["high"], row["n"], row["at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array([c.tobytes() for c in np.ascontiguousarray(vectors.T)], pa.binary())], ["value", "vector"]
                )

    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cut)], "at int, low double, high double, n int")
    found = rows.repartition(len(cut), "at").mapInArrow(run, "value double, vector binary").collect()
    vectors = np.column_stack([np.frombuffer(bytes(r["vector"])) for r in sorted(found, key=lambda r: -r["value"])])
    # Across slices vectors are orthogonal as far as gaps allow; one small Rayleigh-Ritz step makes it exact.
    basis, _ = np.linalg.qr(vectors)
    values, small = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:most], (basis @ small)[:, ::-1][:, :most]
    heaviest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.sign(heaviest)


@dataclass
class Whitener:
    """What the rows of one dimension need: number and sums of the fit list, and the components."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.sums / self.n) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares; none where a long cannot hold it."""
        gaps = self.n * x - self.sums
        rough = (gaps.astype(np.float64) ** 2).sum(axis=1)
        exact = (gaps * gaps).sum(axis=1).tolist()
        return [e if r < 9e18 else None for e, r in zip(exact, rough.tolist(), strict=True)]


def fit(rows: DataFrame, dim: int, most: int = COMPONENTS) -> Whitener | None:
    """Fit ``most`` components on the distinct rows ``x`` (packed) of one dimension."""
    n = rows.count()
    if not n or not dim:
        return None
    sums, v = covariance(rows, dim, n)
    values, vectors = eigenpairs(rows.sparkSession, v, most)
    made = Whitener(n, sums, values, vectors, float(np.trace(v)))
    if len(values):
        _, own = covariance(rows, dim, n, made.whitened)
        made.identity_error = float(np.abs(own - np.eye(len(values))).max())
    return made


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every row of ``vectors``.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (sum
    over dimensions of ``(n x - S) ** 2``), whitened, explained (share of the variance) and
    identity_error (largest entry of the whitened covariance less the identity).

    Cases: rows whose vector is null or has a null or non-finite entry are dropped; rows with a null
    id stay; repeated rows are fitted once and returned each; vectors of another length are fitted
    among themselves; components without variance do not exist, so equal vectors alone give no rows;
    a deviation beyond a long is null; an empty table gives no rows; other columns are left out.
    """
    rows = whole(vectors, id_col, vector_col)
    distinct = settle(rows.select("dim", "x").distinct())
    dims = sorted(r["dim"] for r in distinct.select("dim").distinct().collect())
    models = {d: fit(distinct.where(F.col("dim") == d), d, components) for d in dims}
    models = {d: m for d, m in models.items() if m is not None and len(m.values)}
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            dim = part.column("dim").to_numpy()
            for d, model in models.items():
                at = np.flatnonzero(dim == d)
                k = len(model.values)
                for a in range(0, len(at), 2048):
                    some = pa.array(at[a : a + 2048])
                    x = unpack(part.column("x").take(some).to_pylist(), d)
                    of = pa.array(np.repeat(at[a : a + 2048], k))
                    deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(of),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                            pa.array(np.full(len(of), model.n)),
                            deviation,
                            pa.array(model.whitened(x).ravel()),
                            pa.array(np.tile(model.values / model.trace, len(x))),
                            pa.array(np.full(len(of), model.identity_error)),
                        ],
                        columns,
                    )
        give_back()

    return rows.mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
