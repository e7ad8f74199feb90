"""Embedding whitening by incremental eigendecomposition.

A spectrum is the eigenvalues and eigenvectors of a scatter matrix. Every
partition of the fit list starts at nothing and adds one vector after the
other: the scatter around the mean grows by a centred rank-one term, whose
eigenvalues are the roots of a secular equation (``rank_one``). Equal
eigenvalues and weights near zero are deflated first. Two partitions' spectra
are combined the same way, by one rank-one update for each eigenpair of the
second and one for the shift between their means, in a tree of small groups.

Rounding gathers over many updates, so the combined basis is refined by
distributed Rayleigh-Ritz steps: a pass over the fit list sums the covariance
projected on the basis, whose small eigenproblem turns the basis, and the
next pass measures what is left off the identity. Sums of the integer vectors
are exact at any size, and every product is of centred entries.

What the driver and a task hold is one spectrum, ``dim * (dim + 1)`` doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, stage
from docweave.llm.vectors import fold, grid, lists, matrix, row_pieces

OFFSET = 1_000_000
COMPONENTS = 16
#: Rows of the fit list for each task, where that gives more tasks than the cluster runs at once.
ROWS_A_TASK = 16_384
#: A spectrum has to fit a task and the driver (2048: 34 MB).
MAX_DIM = 2048
#: Rayleigh-Ritz steps end at this error, or when a step no longer halves it.
CLOSE = 1e-10
_EPS = np.finfo(np.float64).eps
_DECIMAL = pa.decimal128(38, 0)
_SPECTRUM = "node int, n long, total array<decimal(38,0)>, vals array<double>, vecs array<double>"


# ------------------------------------------------------------ rank-one updates

def secular(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``w[i, j] = d[j] - root_i`` for the roots of ``1 + sum_j z[j]**2 /
    (d[j] - root) = 0``; ``d`` strictly rising, no ``z`` zero. Each root is
    kept as a distance from its nearer pole, so that no difference cancels.
    Steps interpolate the sums left and right of a root by one pole each; a
    step that leaves the bracket is a bisection."""
    k = len(d)
    z2 = z * z
    gap = np.append(np.diff(d), z2.sum())
    own = np.arange(k)
    at_left = 1 + (z2 / ((d[None, :] - d[:, None]) - gap[:, None] / 2)).sum(axis=1) >= 0
    origin = np.where(at_left | (own == k - 1), own, own + 1)
    lo = np.where(origin == own, np.where(at_left, 0.0, gap / 2), -gap / 2)
    hi = np.where(origin == own, np.where(at_left, gap / 2, gap), 0.0)
    delta = d[None, :] - d[origin][:, None]
    left = np.tri(k, dtype=bool)
    end = d[-1] + gap[-1] - d[origin]           # past the last pole a pole without weight stands in
    tau = (lo + hi) / 2
    right = np.minimum(own + 1, k - 1)
    for _ in range(60):
        w = delta - tau[:, None]
        q = z2 / w
        f = 1 + q.sum(axis=1)
        size = 1 + np.abs(q).sum(axis=1)
        done = (np.abs(f) <= k * _EPS * size) | (hi - lo <= 2 * _EPS * np.abs(tau))
        if done.all():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        slope = q / w
        d_left = np.where(left, slope, 0).sum(axis=1)
        d_right = slope.sum(axis=1) - d_left
        a1 = w[own, own]
        a2 = np.where(own < k - 1, w[own, right], end - tau)
        a = (a1 + a2) * f - a1 * a2 * (d_left + d_right)
        b = a1 * a2 * f
        c = f - a1 * d_left - a2 * d_right
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = tau + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        inside = (step > lo) & (step < hi)
        tau = np.where(done, tau, np.where(inside, step, (lo + hi) / 2))
    return delta - tau[:, None]


def rank_one(vals: np.ndarray, vecs: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (values rising, vectors in columns) of ``vecs diag(vals)
    vecs^T + v v^T``. The weights are computed anew from the roots, so the
    vectors stay orthogonal however close the values are."""
    z = v @ vecs
    weight = float(z @ z)
    if weight == 0:
        return vals, vecs
    tol = 8 * _EPS * max(float(vals[-1]), weight)
    apart = np.diff(vals) > tol
    if not apart.all():                          # equal values: turn them so that one carries the weight
        vecs = vecs.copy()
        cut = np.flatnonzero(apart) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(vals)).tolist()):
            r = np.linalg.norm(z[a:b]) if b - a > 1 else 0.0
            if r:
                h = z[a:b].copy()
                h[-1] += r if h[-1] >= 0 else -r
                sign = -1.0 if z[b - 1] >= 0 else 1.0
                vecs[:, a:b] -= np.outer(vecs[:, a:b] @ h, h) * (2 / (h @ h))
                z[a:b] = 0
                z[b - 1] = sign * r
    live = np.flatnonzero(np.abs(z) * np.sqrt(weight) > tol)
    if not len(live):
        return vals, vecs
    d, zl = vals[live], z[live]
    if len(live) == 1:
        new, turned = d + zl * zl, vecs[:, live]
    else:
        w = secular(d, zl)                       # w[i, j] = d[j] - root_i
        apart_d = d[:, None] - d[None, :]
        np.fill_diagonal(apart_d, 1.0)
        weights = np.sqrt(np.abs(np.prod(-w / apart_d, axis=0)))
        turn = np.copysign(weights, zl)[None, :] / w
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        new, turned = d - np.diagonal(w), vecs[:, live] @ turn.T
    vals, vecs = vals.copy(), vecs.copy()
    vals[live], vecs[:, live] = new, turned
    order = np.argsort(vals, kind="stable")
    return vals[order], vecs[:, order]


def add_vectors(vals: np.ndarray, vecs: np.ndarray, n: int, mean: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Spectrum, count and mean after each of ``rows``."""
    for y in rows:
        off = y - mean
        if n:
            vals, vecs = rank_one(vals, vecs, off * np.sqrt(n / (n + 1)))
        n += 1
        mean = mean + off / n
    return vals, vecs, n, mean


def _spectrum_row(node: int, n: int, total: list[int], vals: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.int32()), pa.array([n], pa.int64()), pa.array([[Decimal(t) for t in total]], pa.list_(_DECIMAL)),
         pa.array([vals.tolist()], pa.list_(pa.float64())), pa.array([vecs.reshape(-1).tolist()], pa.list_(pa.float64()))],
        ["node", "n", "total", "vals", "vecs"])


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of a matrix of longs, exact."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(h << 32) + l for h, l in zip(high.tolist(), low.tolist())]


def _partition_spectra(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vals, vecs, n, mean, total, origin = np.zeros(dim), np.eye(dim), 0, np.zeros(dim), [0] * dim, None
        for part in row_pieces(batches, 1 << 12):
            x = matrix(part.column(0), dim)
            origin = x[0].copy() if origin is None else origin
            total = [a + b for a, b in zip(total, exact_sums(x))]
            vals, vecs, n, mean = add_vectors(vals, vecs, n, mean, (x - origin).astype(np.float64))
        if n:
            yield _spectrum_row(TaskContext.get().partitionId(), n, total, vals, vecs)
    return run


def _combine(dim: int):
    def merge(rows: pa.Table) -> pa.Table:
        got = None
        for r in rows.to_pylist():
            n, total = r["n"], [int(t) for t in r["total"]]
            vals, vecs = np.array(r["vals"]), np.array(r["vecs"]).reshape(dim, dim)
            if got is None:
                got = n, total, vals, vecs
                continue
            m, sums, v, u = got
            for e, column in zip(vals, vecs.T):
                if e > 0:
                    v, u = rank_one(v, u, np.sqrt(e) * column)
            shift = np.array([(a * n - b * m) / (m * n) for a, b in zip(sums, total)])       # means differ by this; integers until the division
            v, u = rank_one(v, u, shift * np.sqrt(m * n / (m + n)))
            got = m + n, [a + b for a, b in zip(sums, total)], v, u
        return pa.Table.from_batches([_spectrum_row(0, *got)])
    return merge


# ------------------------------------------------------------ passes over the fit list

class Centre:
    """The exact mean ``total / n`` as a whole part and a rest."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        self.whole = np.array([t // n for t in total], np.int64)
        self.rest = np.array([t % n for t in total], np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """``sum((n * x - total)**2)``, exact; null where no long holds it.
        Machine words wrap, so a row that is near or below the largest long
        has the right words whatever its terms do."""
        near = self.n ** 2 * (self.off(x) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            words = (x - self.whole) * np.int64(self.n) - self.rest
            out = (words.astype(np.uint64) ** np.uint64(2)).sum(axis=1, dtype=np.uint64)
        return pa.array(out.view(np.int64), mask=(near > 1.5 * 2.0 ** 63) | (out >= np.uint64(1 << 63)))


def _projected(dim: int, centre: Centre, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for part in row_pieces(batches, 1 << 12):
            y = centre.off(matrix(part.column(0), dim)) @ basis
            total += y.T @ y
            n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["node", "total"])
    return run


def _add(rows: pa.Table) -> pa.Table:
    total = np.sum(np.array(rows["total"].to_pylist()), axis=0)
    return pa.table({"node": pa.array([0], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def projected_covariance(fit: DataFrame, dim: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """``basis^T V basis`` summed over the fit list."""
    parts = stage(fit.select("x").mapInArrow(_projected(dim, centre, basis), "node int, total array<double>"))
    total = np.array(fold(parts, _add).first()["total"]).reshape(dim, dim)
    discard(parts)
    return (total + total.T) / (2 * centre.n)


class Whitening:
    """``n``, exact mean, eigenvalues (falling), eigenvectors (columns) and
    the identity error of the first ``components`` of them."""

    def __init__(self, centre: Centre, vals: np.ndarray, vecs: np.ndarray, components: int, error: float | None):
        self.centre, self.vals, self.vecs, self.error = centre, vals, vecs, error
        self.components = min(components, len(vals))
        self.trace = float(vals.sum())


def _held(vals: np.ndarray) -> np.ndarray:
    """Values that are not rounding alone: those a component can be scaled by."""
    return vals > 64 * len(vals) * _EPS * max(float(vals.max()), 0.0)


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct vectors ``x`` of ``fit`` (a staged table, not empty)."""
    spectra = stage(fit.select("x").mapInArrow(_partition_spectra(dim), _SPECTRUM))
    top = fold(spectra, _combine(dim)).first()
    discard(spectra)
    centre = Centre(top["n"], [int(t) for t in top["total"]])
    basis, _ = np.linalg.qr(np.array(top["vecs"]).reshape(dim, dim)[:, ::-1])
    small = projected_covariance(fit, dim, centre, basis)
    best = None
    while True:
        vals, turn = np.linalg.eigh(small)
        vals, basis = np.maximum(vals[::-1], 0.0), np.linalg.qr(basis @ turn[:, ::-1])[0]
        small = projected_covariance(fit, dim, centre, basis)
        use = np.flatnonzero(_held(vals))[:components]
        scale = np.sqrt(vals[use])
        error = float(np.abs(small[np.ix_(use, use)] / np.outer(scale, scale) - np.eye(len(use))).max()) if len(use) else None
        if best is None or (error is not None and error < best.error):
            worse = best is not None and error > best.error / 2
            best = Whitening(centre, vals, basis, components, error)
            if error is None or error <= CLOSE or worse:
                return best
        else:
            return best


def _whiten(dim: int, model: Whitening):
    use = model.components
    held = _held(model.vals)[:use]
    turn = model.vecs[:, :use][:, held] / np.sqrt(model.vals[:use][held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_pieces(batches, 1 << 12):
            x = matrix(part.column(1), dim)
            out = lists(model.centre.off(x) @ turn)
            yield pa.RecordBatch.from_arrays([part.column(0), model.centre.deviation(x), out], ["vec_id", "deviation", "whitened"])
    return run


def fit_list(rows: DataFrame) -> DataFrame:
    """Every distinct ``x`` once, staged in as many files as the passes need tasks."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return stage(rows.select("x").distinct().repartition(tasks, "x"))


def common_width(rows: DataFrame) -> int | None:
    """The commonest vector length; of equally common ones the largest."""
    top = rows.groupBy(F.size("x").alias("w")).count().agg(F.max(F.struct("count", "w")).alias("m")).first()["m"]
    return top["w"] if top else None


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None,
           components: int = COMPONENTS, offset: int = OFFSET) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained,
    identity_error``: one row for each usable vector and component.

    A vector is usable if it has ``dim`` entries (None: the commonest length)
    and none is null, not finite, or beyond the grid; other rows, null and
    empty vectors give no rows. Repeated rows are each returned but count once
    in the fit; rows with one id are kept apart; a null id stays null. Equal
    eigenvalues leave their components' directions free. A component
    without variance (too few distinct vectors) has null ``whitened``; with no
    variance at all ``explained`` and ``identity_error`` are null.
    ``deviation`` is null where it is no long. No usable row: no rows. Other
    columns are not read."""
    spark = vectors.sparkSession
    rows = grid(vectors, id_col, vec_col, offset)
    dim = common_width(rows) if dim is None else dim
    if dim is not None and dim > MAX_DIM:
        raise ValueError(f"a spectrum of {dim} dimensions is larger than a task should hold ({MAX_DIM})")
    rows = rows.filter(F.size("x") == F.lit(dim if dim is not None else -1))
    fit = fit_list(rows)
    if fit.isEmpty():
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model = fit_whitening(fit, dim, components)
    discard(fit)
    out = rows.select("vec_id", "x").mapInArrow(_whiten(dim, model), "vec_id long, deviation long, whitened array<double>")
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.vals[:model.components]]
    number = F.explode(F.sequence(F.lit(1), F.lit(model.components)))
    return (out.select("vec_id", "deviation", "whitened", number.alias("component"))
            .select("vec_id", "component", F.lit(model.centre.n).cast("long").alias("n"), "deviation",
                    F.get("whitened", F.col("component") - 1).alias("whitened"),
                    F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("component") - 1).alias("explained"),
                    F.lit(model.error).cast("double").alias("identity_error")))
