"""Exact nearest rows by cosine distance, with clusters that cannot matter skipped.

``build_index`` stores vectors by cluster. Centers come from a bounded sample
(a few Lloyd rounds on the driver); every row is in the cluster of its nearest
center, and a cluster's radius is the largest distance of a row to it. The
distances are chords between unit vectors, ``sqrt(2 * cosine distance)``,
which obey the triangle inequality: a row of a cluster is at least ``d(q, c)
- radius`` and at most ``d(q, c) + radius`` from a question.

``search`` needs, for each question, a distance that its last wanted row
cannot exceed. One follows from the clusters' bounds and costs alone; scoring
the nearest clusters whose rows fill the question's need gives a much closer
one (done where the index is large enough for another pass to pay). Then only clusters whose lower bound is within it are read, and of them
only rows whose own distance to the center allows it. Any centers give the
same result; good ones only skip more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_staged, stage_table

#: Rows of the sample for each center, and the most centers (with 64 dimensions 8 MB).
SAMPLE_PER_CENTER = 16
MAX_CENTERS = 16_384
LLOYD_ROUNDS = 4
#: An index of more rows is asked for the nearest clusters' rows first, for a closer limit.
PROBE_ROWS = 100_000
#: Chords from rounded cosines are this exact; bounds are loosened by it.
SLACK = 1e-6
BLOCK_CELLS = 4_000_000          # distance cells per block (32 MB of doubles)
ROWS_A_TASK = 200_000


@dataclass
class VectorIndex:
    """``rows``: staged ``(cluster, off, <payload>, vec)`` sorted by cluster and
    distance to the center; the arrays have an entry for each center."""
    rows: DataFrame
    payload: list[str]
    cost_col: str | None
    centers: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    cost: np.ndarray


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cos, 0.0))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def fit_centers(sample: np.ndarray, k: int, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """``k`` unit centers at most, from unit vectors, by spherical Lloyd rounds."""
    centers = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(sample[i:i + 4096] @ centers.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        size = np.sqrt(np.einsum("ij,ij->i", total, total))
        centers = np.where((size > 1e-9)[:, None], total / np.maximum(size, 1e-9)[:, None], centers)
    return centers


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(centers: np.ndarray):
    def run(batches):
        for batch in batches:
            step = max(1, BLOCK_CELLS // len(centers))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                cos = unit(_vectors(part.column(part.num_columns - 1))) @ centers.T
                own = cos.argmax(axis=1)
                near = chord(cos[np.arange(len(own)), own])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(near), *part.columns],
                                                 ["cluster", "off", *part.schema.names])
    return run


def build_index(chunks: DataFrame, payload: list[str], vec_col: str = "embedding", cost_col: str | None = None,
                clusters: int | None = None) -> VectorIndex:
    """Index of ``chunks`` (all vectors of one length). A missing or zero
    vector has no distance to anything: it is left out. ``clusters`` defaults
    to the root of the number of rows, at most ``MAX_CENTERS``."""
    usable = F.col(vec_col).isNotNull() & F.exists(vec_col, lambda v: v != 0)
    src = chunks.filter(usable).select(*payload, F.col(vec_col).alias("vec"))
    n = src.count()
    k = clusters or min(MAX_CENTERS, max(1, int(n ** 0.5)))
    sample = (src.select("vec", F.xxhash64(*payload).alias("h")).orderBy("h", "vec").limit(k * SAMPLE_PER_CENTER)
              .select("vec").toArrow()["vec"].combine_chunks())                   # bounded
    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("off", T.DoubleType()), *src.schema.fields]
    if not len(sample):
        empty = np.zeros(0)
        return VectorIndex(stage_table(chunks.sparkSession.createDataFrame([], T.StructType(fields))), payload, cost_col, np.zeros((0, 1)), empty, empty, empty)
    centers = fit_centers(unit(_vectors(sample)), k)
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    # written before it is dealt by ranges, whose borders are then sampled from two columns
    assigned = stage_table(src.mapInArrow(_assign(centers), T.StructType(fields)))
    rows = stage_table(assigned.repartitionByRange(tasks, "cluster", "off").sortWithinPartitions("cluster", "off"))
    drop_staged(assigned)
    about = rows.groupBy("cluster").agg(F.max("off").alias("radius"), F.count("*").alias("n"),
                                        F.sum(F.col(cost_col).cast("double") if cost_col else F.lit(0.0)).alias("cost")).toArrow()
    at = about["cluster"].to_numpy()                                              # a row for each center at most
    out = [np.zeros(len(centers)) for _ in range(3)]
    for array, name in zip(out, ("radius", "n", "cost")):
        array[at] = about[name].to_numpy()
    return VectorIndex(rows, payload, cost_col, centers, *out)


# ---------------------------------------------------------------- which clusters matter

@dataclass
class Need:
    """What a question wants: its first ``cap`` rows (None: no such bound),
    and of them those whose summed ``cost + per_row`` is within ``budget``
    (None: no budget) and the one that goes over it."""
    cap: int | None = None
    budget: float | None = None
    per_row: float = 0.0

    def filled(self, count: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Whether so many rows of such cost surely hold every wanted row."""
        done = np.zeros(len(count), bool)
        if self.cap is not None:
            done |= count >= self.cap
        if self.budget is not None:
            done |= cost + self.per_row * count > self.budget
        return done


def _until_filled(index: VectorIndex, need: Need, order: np.ndarray) -> int:
    """How many clusters of ``order`` fill the need (all, if they don't)."""
    done = np.flatnonzero(need.filled(np.cumsum(index.count[order]), np.cumsum(index.cost[order])))
    return int(done[0]) + 1 if len(done) else len(order)


def cluster_bounds(index: VectorIndex, need: Need, questions: np.ndarray):
    """For unit ``questions``: distances to the centers, the first clusters to
    look at (boolean matrix), and a distance that no wanted row exceeds."""
    to_center = chord(questions @ index.centers.T)
    used = index.count > 0
    first = np.zeros(to_center.shape, bool)
    limit = np.full(len(questions), np.inf)
    for i, d in enumerate(to_center):
        high = np.where(used, d + index.radius, np.inf)
        order = np.argsort(high, kind="stable")
        m = _until_filled(index, need, order)
        if need.filled(index.count[order[:m]].sum()[None], index.cost[order[:m]].sum()[None])[0]:
            limit[i] = high[order[m - 1]]
        near = np.argsort(np.where(used, d, np.inf), kind="stable")
        first[i, near[:_until_filled(index, need, near)]] = True
    return to_center, first & used, limit


def clusters_within(index: VectorIndex, to_center: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Clusters (boolean matrix) that may hold a row within each question's limit."""
    return (to_center - index.radius <= limit[:, None] + SLACK) & (index.count > 0)


# ---------------------------------------------------------------- scoring

def _order_key(values: np.ndarray) -> np.ndarray:
    """Numbers as they are; anything else by its rank."""
    return values if values.dtype.kind in "iuf" else np.unique(values, return_inverse=True)[1]


class _Held:
    """The best rows of each question so far, as arrays: at most what its need takes."""

    def __init__(self, need: Need, ids: list[str], payload: list[str], cost_col: str | None):
        self.need, self.ids, self.payload, self.cost_col = need, ids, payload, cost_col
        self.rows: pa.Table | None = None
        self.new: list[pa.Table] = []
        self.waiting = 0

    def add(self, rows: pa.Table) -> None:
        self.new.append(rows)
        self.waiting += rows.num_rows
        if self.waiting > max(1 << 16, 0 if self.rows is None else self.rows.num_rows):
            self.settle()

    def settle(self) -> pa.Table | None:
        parts = ([] if self.rows is None else [self.rows]) + self.new
        if not parts:
            return None
        t = pa.concat_tables(parts)
        q = t["q"].to_numpy()
        keys = [_order_key(t[c].to_numpy()) for c in reversed(self.ids)]
        order = np.lexsort((*keys, t["distance"].to_numpy(), q))
        q = q[order]
        first = np.searchsorted(q, q)
        keep = np.ones(len(q), bool)
        if self.need.cap is not None:
            keep &= np.arange(len(q)) - first < self.need.cap
        if self.need.budget is not None:
            cost = t[self.cost_col].to_numpy().astype(np.float64)[order] + self.need.per_row
            before = np.cumsum(cost) - cost
            keep &= before - before[first] <= self.need.budget           # the first row over the budget stays
        self.rows, self.new, self.waiting = t.take(pa.array(order[keep])), [], 0
        return self.rows


def _score(need: Need, ids, payload, cost_col, questions, to_center, use, limit, block_cells):
    """Scores rows against the questions that use their cluster. Rows come
    sorted by cluster and distance to the center, so a cluster's rows are a
    slice, and of it only those can be within a question's limit whose own
    distance to the center differs from the question's by no more. ``use``,
    ``to_center`` and ``limit`` are broadcast."""
    def run(batches):
        held = _Held(need, ids, payload, cost_col)
        for batch in batches:
            cluster, off = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cluster", "off"))
            start = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1]))) if len(cluster) else []
            for a, b in zip(start, [*start[1:], len(cluster)]):
                c = int(cluster[a])
                asked = np.flatnonzero(use.value[:, c])
                if not len(asked):
                    continue
                near, reach = to_center.value[asked, c], limit[asked] + SLACK
                lo, hi = np.searchsorted(off[a:b], [(near - reach).min(), (near + reach).max()]) + [0, 1]
                rows = batch.slice(a + lo, min(hi, b - a) - lo)
                if not rows.num_rows:
                    continue
                vec = _vectors(rows.column(rows.schema.get_field_index("vec")))
                size = np.einsum("ij,ij->i", vec, vec)
                data = pa.Table.from_batches([rows.select(payload)])
                step = max(1, block_cells // len(vec))
                for i in range(0, len(asked), step):
                    qs = asked[i:i + step]
                    qmat, qsize = questions.value[0][qs], questions.value[1][qs]
                    d = np.minimum(np.abs(1.0 - (vec @ qmat.T) / np.sqrt(size[:, None] * qsize[None, :])), 2.0)
                    r, col = np.nonzero(np.sqrt(2.0 * d) <= limit[qs][None, :] + SLACK)
                    if len(r):
                        held.add(data.take(pa.array(r)).append_column("q", pa.array(qs[col].astype(np.int64))).append_column("distance", pa.array(d[r, col])))
        rows = held.settle()
        if rows is not None:
            yield from rows.select([*payload, "q", "distance"]).to_batches()
    return run


def search(index: VectorIndex, question_ids: list, vectors: np.ndarray, need: Need, ids: list[str], id_field: T.StructField,
           block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``(<payload>, question id, distance)``: for each question every row that
    its need can take, best of each task. ``vectors``: a bounded matrix
    without zero rows."""
    spark = index.rows.sparkSession
    fields = [index.rows.schema[c] for c in index.payload]
    out_schema = T.StructType([*fields, T.StructField("q", T.LongType()), T.StructField("distance", T.DoubleType())])
    if not len(index.centers) or not len(question_ids):
        return spark.createDataFrame([], T.StructType([*fields, id_field, T.StructField("distance", T.DoubleType())]))
    sc = spark.sparkContext
    to_center, first, limit = cluster_bounds(index, need, unit(vectors))
    matrix, centers = sc.broadcast((vectors, np.einsum("ij,ij->i", vectors, vectors))), sc.broadcast(to_center)

    def scored(use, limit):
        rows = index.rows
        wanted = np.flatnonzero(use.any(axis=0))
        if len(wanted) < 1000 and len(wanted) < len(index.centers):
            rows = rows.filter(F.col("cluster").isin([int(c) for c in wanted]))    # sorted files: other row groups are not read
        return rows.select("cluster", "off", *index.payload, "vec").mapInArrow(
            _score(need, ids, index.payload, index.cost_col, matrix, centers, sc.broadcast(use), limit, block_cells), out_schema)

    if index.count.sum() > PROBE_ROWS:
        limit = _probed(index, need, ids, scored(first, limit), limit)
    out = scored(clusters_within(index, to_center, limit), limit)
    names = spark.createDataFrame([(i, v) for i, v in enumerate(question_ids)], T.StructType([T.StructField("q", T.LongType()), id_field]))
    return out.join(F.broadcast(names), "q").select(*index.payload, id_field.name, "distance")


def _probed(index: VectorIndex, need: Need, ids: list[str], rows: DataFrame, limit: np.ndarray) -> np.ndarray:
    """``limit`` lowered to the distance of the last row that each question's need takes of ``rows``."""
    near = best_rows(rows, ["q"], ids, need, index.cost_col)
    last = near.groupBy("q").agg(F.max("distance").alias("d"), F.count("*").alias("n"),
                                 F.sum(F.col(index.cost_col).cast("double") if index.cost_col else F.lit(0.0)).alias("cost")).toArrow()
    q = last["q"].to_numpy()
    full = need.filled(last["n"].to_numpy().astype(np.float64), last["cost"].to_numpy())
    limit = limit.copy()
    limit[q[full]] = np.minimum(limit[q[full]], np.sqrt(2.0 * last["d"].to_numpy()[full]))
    return limit


def best_rows(rows: DataFrame, by: list[str], ids: list[str], need: Need, cost_col: str | None) -> DataFrame:
    """Of ``rows`` with ``distance``: those that each question's need takes, and
    the first that goes over its budget. Adds ``rank`` and, with a budget, ``before`` and ``used``."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.col("distance").asc(), *[F.col(c).asc() for c in ids])
    rows = rows.withColumn("rank", F.row_number().over(w))
    if need.cap is not None:
        rows = rows.filter(F.col("rank") <= need.cap)
    if need.budget is not None:
        cost = F.col(cost_col) + F.lit(need.per_row).cast(rows.schema[cost_col].dataType)
        rows = rows.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        rows = rows.withColumn("before", F.col("used") - cost).filter(F.col("before") <= need.budget)
    return rows
