"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints that differ in at most ``distance`` bits are linked; a document's
class is the smallest id that it reaches over links.

Method. 62 of the 64 bits are read as two words of 31 bits. Two fingerprints
within 3 bits differ in at most 1 bit in one of the words. The anchors of a
word are the code words of the perfect Hamming code of length 31: every word
is within covering radius 1 of exactly one anchor. A fingerprint is
replicated to every anchor within radius plus threshold (1 + 1 = 2): 1 or 16
of the 2**26 anchors of a word. If x and y differ in at most one bit of the
word, y is within 2 of x's nearest anchor, so they meet there. The whole
64-bit distance is compared per anchor.

Only distinct fingerprints are replicated, so a group of exact copies is one
row. Within an anchor a breadth-first search over the unvisited members gives
a spanning forest: never more links than members, however dense the group.
An anchor with more than ``hot`` members is cut into chunks and every pair of
chunks is its own group, so no anchor has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import components, partitions, row_blocks, stage, text_bytes
from docweave.llm.keep import keep_one, row_key

SHINGLE = 3
DISTANCE = 3
SEED = 42
HOT = 4096
_CHUNK_BITS = 65_536


def _fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()        # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    whole = b" ".join(words)
    n = len(words) - width + 1
    ends = ends[width - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK_BITS):
        h = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts[i:i + _CHUNK_BITS], ends[i:i + _CHUNK_BITS])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, row_key, fp)``: the 64-bit SimHash of each whole text as a signed
    long. Null and empty texts, and texts without words, have 0; a text of
    fewer than ``width`` words is one shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text", 1 << 22):
                fp = np.array([_fingerprint(t, width) for t in text_bytes(part.column(2))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                      F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, row_key long, fp long")


_MASK31 = np.uint64((1 << 31) - 1)


def _anchors(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every code word within 2 of each 31-bit word. The
    syndrome s is the XOR of the positions (1..31) of the set bits: 0 marks a
    code word; otherwise flipping bit s reaches the nearest one, and flipping
    any two positions whose XOR is s reaches those at distance 2."""
    s = np.zeros(len(word), np.int64)
    for p in range(1, 32):
        s ^= np.where((word >> np.uint64(p - 1)) & np.uint64(1), p, 0)
    bit = np.concatenate(([0], 1 << np.arange(31))).astype(np.uint64)
    rows, out = [np.arange(len(word))], [word ^ bit[s]]
    for p in range(1, 32):
        q = s ^ p
        ok = np.flatnonzero((s != 0) & (q > p))
        rows.append(ok)
        out.append(word[ok] ^ bit[p] ^ bit[q[ok]])
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for part, shift in ((0, 0), (1, 32)):
            rows, anchor = _anchors((fp >> np.uint64(shift)) & _MASK31)
            key = anchor.astype(np.int64) | np.int64(part << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows].view(np.int64))], ["anchor", "fp"])


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among ``fp``: each
    member leaves the unvisited set when first reached."""
    out = []
    left = np.arange(len(fp))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= distance
            if near.any():
                got = left[near].tolist()
                out.extend((u, v) for v in got)
                queue.extend(got)
                left = left[~near]
    return out


def _link(distance: int):
    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((first, [len(key)])))
        two = first[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            own = fp[s:s + n]
            pairs = forest(own, distance)
            if pairs:
                i, j = np.array(pairs).T
                a.append(own[i])
                b.append(own[j])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []      # rows from the last, still open, group on

        def flush():
            key, fp = (np.concatenate(x) for x in zip(*held))
            a, b = links(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            anchor, sub, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = np.empty(len(anchor), [("anchor", np.int64), ("sub", np.int64)])
            key["anchor"], key["sub"] = anchor, sub
            fp = fp.view(np.uint64)
            change = np.flatnonzero(key[1:] != key[:-1])
            closes = held and (held[-1][0][-1] != key[0])
            last = int(change[-1]) + 1 if len(change) else (0 if closes else -1)
            if last >= 0:
                held.append((key[:last], fp[:last])) if last else None
                if held:
                    yield flush()
                held = []
            last = max(last, 0)
            held.append((key[last:], fp[last:]))
        if held:
            yield flush()
    return run


def links(unique: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` that connect every two fingerprints within
    ``distance`` bits (directly or over others). ``unique``: distinct ``fp``."""
    if distance != DISTANCE:
        raise ValueError("the covering code is laid out for 3 bits")
    n = partitions(unique)
    # dealt out first (a small table is few splits), written once: counted, then dealt by anchor
    rows = stage(unique.select("fp").repartition(n, "fp").mapInArrow(_replicate, "anchor long, fp long"))
    large = stage(rows.groupBy("anchor").count().filter(F.col("count") > hot)
                  .select("anchor", F.ceil(F.col("count") / (hot / 2)).cast("int").alias("chunks")))
    if large.isEmpty():
        keyed = rows.select("anchor", F.lit(0).cast("long").alias("sub"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("chunks"), F.lit(1)).cast("long") - 1))
        keyed = (rows.join(large, "anchor", "left")
                 .select("anchor", "fp", "chunks", F.coalesce(own, F.lit(0).cast("long")).alias("own"), other.alias("other"))
                 .select("anchor", (F.least("own", "other") * F.coalesce("chunks", F.lit(1)) + F.greatest("own", "other"))
                         .alias("sub"), "fp"))
    return (keyed.repartition(n, "anchor", "sub").sortWithinPartitions("anchor", "sub", "fp")
            .mapInArrow(_link(distance), "a long, b long").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: ``doc_id, row_key, fp, label, component_id``;
    ``label`` is the class's least fingerprint.

    Null and empty texts have fingerprint 0 and are linked like any other;
    ties and repeated rows share a fingerprint and so a class; an empty table
    gives no rows; other columns are not read. A null id takes part, but
    names a class only where no row of it has an id (then it is null)."""
    fps = stage(fingerprints(docs, id_col, text_col, width))
    unique = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(unique, distance))
    named = (unique.join(label, unique.fp == label.node, "left")
             .select("fp", F.coalesce("label", "fp").alias("label"), "least"))
    named = stage(named)
    low = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(low, "label").select("fp", "label", "component_id")
    return fps.join(classes, "fp").select("doc_id", "row_key", "fp", "label", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one that names it; all
    columns stay. Of several such rows the least row_key stays, and one of
    rows that agree in it too."""
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    stay = near_groups(docs, id_col, text_col).groupBy("label").agg(F.min(name).alias("name"))
    return keep_one(docs, id_col, text_col, stay.select("name.doc_id", "name.row_key"))
