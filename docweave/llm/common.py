"""Helpers shared by the operators of this subpackage.

* ``stage``: cut lineage with a Parquet table in the cluster's shared
  checkpoint folder (compressed, survives lost executors, gives Catalyst a
  size for its join choice).
* ``components``: connected components by alternating large-star and
  small-star joins, O(log n) rounds, no group ever gathered.
* numpy helpers that tokenise and hash whole Arrow batches at once.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import ensure_checkpoint_dir

#: Word separators of the contracts: ``[\x20\x09-\x0D]``.
WORD = r"[^\x20\x09-\x0D]+"
SMALL_ROWS = 50_000


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a read of it. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def stage_by(df: DataFrame, key: str) -> DataFrame:
    """``stage`` in buckets by ``key``: joins on it read the rows where they
    lie. ``df`` is to be dealt by ``key`` into ``partitions(df)`` parts."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(partitions(df), key).sortBy(key).saveAsTable(name)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.table(name)
    out._stage_path, out._stage_name = path, name
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables made by ``stage`` that nothing reads any more."""
    for df in staged:
        if hasattr(df, "_stage_name"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._stage_name}")
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a staged table of at most ``rows`` short rows;
    a larger one is joined by shuffle. Use on staged tables only: the count
    reads Parquet footers."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-case A-Z only. An all-ASCII text takes the byte-wise path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, upper, upper.lower()))


def unit_uniform(*cols):
    """Deterministic uniform number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (columns ``a``, ``b``,
    any orderable type); ``label`` is the smallest node of the component."""
    def summary(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31)).alias("s")).first()
        return r["n"], r["s"]

    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
              .filter("a <> b").distinct())
    seen = summary(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .filter("a <> b").distinct())
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small_star = (large.join(low2, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
                      .union(low2.select(F.col("m").alias("a"), "b")))
        e = stage(small_star.distinct())
        now = summary(e)
        if now == seen:
            break
        seen = now
    return (e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
            .union(e.select("a", "a").distinct()))


# ---------------------------------------------------------------- numpy side

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}
PIECE = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length())
    if "up" not in _POW or len(_POW["up"]) < size:
        with np.errstate(over="ignore"):
            for key, m in (("up", _MULT), ("down", _INV)):
                a = np.full(size, m, np.uint64)
                a[0] = 1
                _POW[key] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(buf: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero byte class."""
    c = classes[buf]
    edge = np.flatnonzero(c[1:] != c[:-1]) + 1
    cuts = np.concatenate(([0], edge, [len(c)])) if len(c) else np.zeros(1, np.int64)
    keep = c[cuts[:-1]] != 0 if len(c) else np.zeros(0, bool)
    return cuts[:-1][keep], cuts[1:][keep]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span's bytes (``fold`` maps bytes first). Works in
    pieces, so scratch memory does not grow with the buffer."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    table = (np.arange(256) if fold is None else fold).astype(np.uint64) + np.uint64(1)
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring hashes (order matters)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k: k + len(out)]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
        out ^= out >> np.uint64(32)
    return mix64(out)


def release() -> None:
    """Give the memory that freed arrays and batches left in this process back
    to the system: a Python worker stays for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # glibc only
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of slices with at most ``limit`` bytes of text (one row at least)."""
    import pyarrow.compute as pc
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield i, j
        i = j


def row_blocks(batch: pa.RecordBatch, column: str, limit: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (one row at
    least), so that scratch arrays stay small; after them freed memory is released."""
    for i, j in cuts(batch.column(batch.schema.get_field_index(column)), limit):
        yield batch.slice(i, j - i)
    release()


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer with a separator after each text, and the start of
    each text in it."""
    buf = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + len(sep)
    return buf, np.concatenate(([0], np.cumsum(size)))[:-1]


def byte_classes(*groups: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, group in enumerate(groups, 1):
        table[list(group)] = k
    return table


SPACE = b" \t\n\x0b\x0c\r"
NOT_SPACE = byte_classes(bytes(set(range(256)) - set(SPACE)))
ALNUM = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum())
ALNUM_CLASS = byte_classes(ALNUM)
#: Runs of letters and digits, and runs of other visible characters.
WORD_PUNCT = byte_classes(ALNUM, bytes(set(range(33, 127)) - set(ALNUM)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
