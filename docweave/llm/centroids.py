"""Centroid clustering (Lloyd rounds) with ns-bounds.

Every vector keeps an upper bound on the distance to its own centroid and a
lower bound on the distance to all others, each with the round in which it was
evaluated. Centroids of all rounds are kept. In a later round a bound is
loosened by the norm of the whole displacement between the centroid then and
now, which is at most (and mostly far below) the sum of the drifts round by
round. A vector whose upper bound stays below its lower bound keeps its
centroid without any distance; otherwise the own distance is evaluated, and
if that doesn't settle it, all distances are, exactly, on integers.

A round is one pass over the staged vectors with their bounds. The same pass
sums each task's vectors by cluster, exactly, so the next centroids need no
second pass; the driver holds centroids (rounds * k * dim integers) only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import discard, stage
from docweave.llm.vectors import grid, lists, matrix, row_pieces

CLUSTERS = 16
ROUNDS = 3
DIM = 64
ROWS_A_TASK = 65_536
#: Bounds are doubles; they decide only where they differ by more than their rounding.
SLACK = 1e-9
_LONG = 1 << 63
#: Rows of vectors (``sums`` false), and each task's sums by cluster: ``x`` holds high then low 32-bit halves, ``distance`` the count.
_STATE = "sums boolean, vec_id long, x array<long>, cluster int, distance long, own double, own_round int, low double, low_round int, scans int"


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer matrices: in
    doubles where these are exact, else in machine words, else in Python
    integers."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    width = x.shape[1]
    if 4 * width * big * big < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    if 4 * width * big * big >= _LONG:
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def norms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the differences of two centroid matrices, rounded up."""
    off = (a - b).astype(np.float64)
    return np.sqrt((off * off).sum(axis=1)) * (1 + SLACK)


class Assigner:
    """Assigns rows in the round that ``history`` has reached (its last centroids)."""

    def __init__(self, history: list[np.ndarray], last: bool):
        self.history, self.now, self.t, self.last = history, history[-1], len(history) - 1, last
        self.moved = np.stack([norms(self.now, old) for old in history])            # by round of evaluation and centroid
        rank = np.sort(self.moved, axis=1)
        self.most, self.second = rank[:, -1], rank[:, -2] if rank.shape[1] > 1 else rank[:, -1] * 0
        self.widest = self.moved.argmax(axis=1)

    def own_distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), object)
        for j in np.unique(cluster):
            at = cluster == j
            out[at] = squared_distances(x[at], self.now[j:j + 1])[:, 0]
        return out

    def __call__(self, x, cluster, own, own_round, low, low_round, scans):
        """``cluster, distance, own, own_round, low, low_round, scans`` after
        this round; ``distance`` (exact, object) is set in the last round only."""
        n = len(x)
        distance = np.full(n, None, object)
        if self.t:
            upper = own + self.moved[own_round, cluster]
            others = np.where(self.widest[low_round] == cluster, self.second[low_round], self.most[low_round])
            lower = low - others
            todo = ~(upper * (1 + SLACK) < lower * (1 - SLACK))
            near = np.flatnonzero(todo) if not self.last else np.arange(n)
            exact = self.own_distance(x[near], cluster[near])
            distance[near] = exact
            own[near], own_round[near] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK), self.t
            todo &= ~(own * (1 + SLACK) < lower * (1 - SLACK))
        else:
            todo = np.ones(n, bool)
        rows = np.flatnonzero(todo)
        if len(rows):
            d = squared_distances(x[rows], self.now)
            best = d.argmin(axis=1)                                  # first of equal ones: the smaller number
            near = d[np.arange(len(rows)), best]
            distance[rows] = near
            cluster[rows], own[rows], own_round[rows] = best, np.sqrt(near.astype(np.float64)) * (1 + SLACK), self.t
            if d.shape[1] > 1:
                d = d.astype(np.float64)
                d[np.arange(len(rows)), best] = np.inf
                low[rows] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
            else:
                low[rows] = np.inf
            low_round[rows] = self.t
            scans[rows] += 1
        return cluster, distance, own, own_round, low, low_round, scans


def _round(dim: int, history: list[np.ndarray], last: bool):
    k = len(history[-1])

    def column(batch, name):
        return batch.column(batch.schema.get_field_index(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(history, last)
        halves, count = np.zeros((k, 2 * dim), np.int64), np.zeros(k, np.int64)

        def rows(sums, ids, x, cluster, distance, own, own_round, low, low_round, scans):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cluster), sums)), ids, lists(x), pa.array(cluster), distance,
                                               pa.array(own), pa.array(own_round), pa.array(low), pa.array(low_round), pa.array(scans)],
                                              ["sums", "vec_id", "x", "cluster", "distance", "own", "own_round", "low", "low_round", "scans"])

        for part in row_pieces(batches, 1 << 13):
            x = matrix(column(part, "x"), dim)
            state = [column(part, c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "own", "own_round", "low", "low_round", "scans")]
            cluster, distance, *bounds = assign(x, *state)
            count += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                at = x[cluster == j]
                halves[j] += np.concatenate(((at >> 32).sum(axis=0), (at & 0xFFFFFFFF).sum(axis=0)))
            exact = pa.array([None if d is None or d >= _LONG else int(d) for d in distance] if last else [None] * len(x), pa.int64())
            yield rows(False, column(part, "vec_id"), x, cluster, exact, *bounds)
        used = np.flatnonzero(count)
        if len(used) and not last:
            none = np.zeros(len(used))
            number = none.astype(np.int32)
            yield rows(True, pa.nulls(len(used), pa.int64()), halves[used], used.astype(np.int32), pa.array(count[used]), none, number, none, number, number)
    return run


def seeds(rows: DataFrame, k: int) -> list[list[int]]:
    """Vectors of the ``k`` rows whose ``1:<vec_id>`` has the smallest hash;
    ties by the vector, null ids last."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in rows.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()]


def next_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Floor of the exact mean by cluster and component; empty ones stay."""
    sums = state.filter("sums")
    dim = now.shape[1]
    count = {r["cluster"]: r["n"] for r in sums.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    total = (sums.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i")
             .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect())
    out = now.copy()
    halves = {(r["cluster"], r["i"]): int(r["s"]) for r in total}
    for j, n in count.items():
        out[j] = [((halves[j, i] << 32) + halves[j, dim + i]) // n for i in range(dim)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS,
            rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Staged ``(vec_id, x, cluster, distance, scans)`` for each usable
    vector, and the final centroids. ``scans`` counts the rounds in which all
    distances were evaluated. See ``centroid_clusters`` for the cases."""
    rows = grid(vectors, id_col, vec_col).filter(F.size("x") == dim)
    first = seeds(rows, k)
    history = [np.array(first, np.int64).reshape(len(first), dim)]
    zero = [F.lit(0).alias(c) for c in ("cluster", "own_round", "low_round", "scans")]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // ROWS_A_TASK))
    state = rows.repartition(tasks).select("vec_id", "x", *zero, F.lit(0.0).alias("own"), F.lit(0.0).alias("low"))
    old = None
    for t in range(rounds + 1 if len(first) else 1):
        now = stage(state.mapInArrow(_round(dim, list(history), t == rounds), _STATE))
        if old is not None:
            discard(old)
        if t < rounds and len(first):
            history.append(next_centroids(now, history[-1]))
        old, state = now, now.filter("not sums").drop("sums", "distance")
    return now.filter("not sums").select("vec_id", "x", "cluster", "distance", "scans"), history[-1]


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS,
                      rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, scans``: one row for each usable vector.

    Usable: ``dim`` entries, none null, not finite or beyond the grid; other
    rows give no rows. Repeated rows and rows with one id are vectors of their
    own. Of equally near centroids the smaller number is taken, so of equal
    seeds the later stay empty. A null id stays null and is a seed only where
    there are fewer than ``k`` others. With fewer than ``k`` usable rows each
    is a seed; with none there are no rows. A distance or inertia that is no
    long is null. Other columns are not read."""
    spark: SparkSession = vectors.sparkSession
    rows, centroids = cluster(vectors, id_col, vec_col, dim, k, rounds)
    sums = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                                                   F.count_if(F.col("distance").isNull()).alias("bad")).collect()}

    def fits(parts):
        total = None if any(p["bad"] for p in parts) else sum(int(p["s"]) for p in parts)
        return None if total is None or total >= _LONG else total

    said = [(j, fits([r]), fits(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, r in sums.items()]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
