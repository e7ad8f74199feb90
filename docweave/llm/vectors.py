"""Embedding rows as integer vectors, read alike by the whitening and the
centroid clustering, and small Spark folds over per-task results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
#: Larger entries have no exact place on the integer grid (2**62 in a long).
LARGEST = float(1 << 56)


def grid(df: DataFrame, id_col: str, vec_col: str, offset: int = 0) -> DataFrame:
    """``(vec_id, x)``: ``floor(64 * entry) + offset`` of every row whose
    vector has entries, none of them null, not finite, or of 2**56 and more."""
    usable = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)), F.lit(False)))
    whole = F.transform("vec", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(offset).cast("long"))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & usable).select("vec_id", whole.alias("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of one width, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(values.reshape(-1)))


def row_pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that scratch arrays stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fold(parts: DataFrame, merge: Callable[[pa.Table], pa.Table], fan: int = 8) -> DataFrame:
    """Merge rows ``(node int, ...)`` in a tree: rows whose ``node`` agrees
    after division by ``fan`` meet in one task, at most ``fan`` of them for
    distinct nodes, until node 0 is left. ``merge`` gets rows by rising node
    and returns one row; its ``node`` is set here. ``parts`` is read once more
    for the largest node, so it should be a staged table."""
    top = parts.agg(F.max("node").alias("m")).first()["m"] or 0

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        got = merge(rows)
        return got.set_column(got.schema.get_field_index("node"), "node", pa.array([rows["node"][0].as_py() // fan], pa.int32()))

    while True:
        parts = parts.groupBy(F.expr(f"node div {fan}").alias("__up")).applyInArrow(one, parts.schema)
        top //= fan
        if not top:
            return parts
