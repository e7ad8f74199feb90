"""Substring dedup over super-k-mers.

A window is ``width`` consecutive words of one document. The minimiser of a
window is its least ``order``-word gram, by a hash. Consecutive windows with
the same minimiser overlap in all but one word, so they travel together, as
one packed string (a super-k-mer), to the bucket that the minimiser names.
Equal windows have equal minimisers, so all their occurrences meet in one
bucket, where sorting groups them exactly: by a 64-bit hash, and then by
comparing the words themselves.

Hot spots. Grams whose hash bin is far above the mean count (a first pass
over all documents) rank last, so they are minimisers only where a window
has no other gram; such windows lie inside a repeated passage, and equal
super-k-mers are combined on the map side: only a task's first occurrence
travels, the others are repeats for certain. So a passage that a third of
the documents share costs a bucket one string a task.

Documents are ordered by (id, hash of the text); a null id counts as the
largest. Rows that agree in both are one document: they get the same result
and do not remove each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import (NOT_SPACE, PIECE, _powers, gram_hashes, joined, mix64, partitions, release, row_blocks,
                                 span_hashes, spans, text_bytes)

WIDTH = 20
ORDER = 3
BINS = 1 << 16
HOT = 8
FLUSH = 48 << 20
RUN = 256
LEVEL = 6
_LAST = (1 << 63) - 1


def _bin_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for part in row_blocks(batch, "text"):
                buf, _ = joined(text_bytes(part.column(0)))
                h = gram_hashes(span_hashes(buf, *spans(buf, NOT_SPACE)), order)
                total += np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bin", "n"])
    return run


def hot_bins(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> np.ndarray:
    """Flags of the hash bins whose grams are common, from counts over all
    documents. ``BINS`` counters come to the driver, whatever the input."""
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(_bin_counts(order), "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")).collect())
    count = np.zeros(BINS, np.int64)
    for r in rows:
        count[r["bin"]] = r["n"]
    return count > HOT * max(1.0, count.sum() / BINS)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, by prefix sums over pieces, so
    that neither scratch nor the table of powers grows with the input."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(h) - n + 1, np.uint64)
    step = max(PIECE - n, n)
    up, down = _powers(step + n)
    for i in range(0, len(out), step):
        part = h[i: i + step + n - 1]
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=acc[1:])
        out[i: i + step] = mix64((acc[n:] - acc[:-n]) * down[: len(part) - n + 1])
    return out


class _Strings:
    """Super-k-mers of one task between two flushes."""

    def __init__(self) -> None:
        self.cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        self.text: list[bytes] = []
        self.bytes = 0

    def add(self, text: list[bytes], *cols: np.ndarray) -> None:
        self.text.extend(text)
        for own, c in zip(self.cols, cols):
            own.append(c)
        self.bytes += int(cols[5].sum())


def _blob(arrays: list[np.ndarray], text: bytes = b"") -> bytes:
    head = np.array([len(arrays[0])], "<i8").tobytes()
    arrays = [np.diff(arrays[0], prepend=0), *arrays[1:]]
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(a.astype("<i8").tobytes() for a in arrays) + text)


def _unblob(blob: bytes, k: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    arrays = [np.frombuffer(raw, "<i8", n, 8 + 8 * n * i) for i in range(k)]
    return [np.cumsum(arrays[0]), *arrays[1:]], raw[8 + 8 * n * k:]


def _rows(kind: int, bucket: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.large_binary()).cast(pa.binary())],
        ["bucket", "kind", "blob"])


def _flush(s: _Strings, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket, hashed, ident, key, start, size = (np.concatenate(c) for c in s.cols)
    order = np.lexsort((start, key, ident, hashed, bucket))
    bucket, hashed, ident, key, start, size = (c[order] for c in (bucket, hashed, ident, key, start, size))
    text = [s.text[i] for i in order.tolist()]
    keep = np.ones(len(text), bool)
    first = 0
    for i in np.flatnonzero((hashed[1:] == hashed[:-1]) & (bucket[1:] == bucket[:-1])).tolist():
        i += 1
        if keep[i - 1] and hashed[i - 1] == hashed[i]:
            first = i - 1
        keep[i] = text[i] != text[first]
    again = np.flatnonzero(~keep)
    if len(again):
        firsts = np.maximum.accumulate(np.where(keep, np.arange(len(keep)), 0))[again]
        other = (ident[again] != ident[firsts]) | (key[again] != key[firsts]) | (start[again] != start[firsts])
        again = again[other]
        words = np.array([text[i].count(b" ") + 1 for i in again.tolist()], np.int64)
        dealt = (mix64(key[again].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(dealt, kind="stable")
        cuts = np.flatnonzero(np.diff(dealt[by])) + 1
        groups = [g for g in np.split(by, cuts) if len(g)]
        if groups:
            yield _rows(1, [int(dealt[g[0]]) for g in groups],
                        [_blob([ident[again[g]], key[again[g]], start[again[g]], start[again[g]] + words[g]]) for g in groups])
    idx = np.flatnonzero(keep)
    idx = idx[np.lexsort((start[idx], key[idx], ident[idx], bucket[idx]))]      # neighbours of one document compress better
    cuts = np.flatnonzero(np.diff(bucket[idx])) + 1
    names, blobs, held = [], [], 0
    for g in np.split(idx, cuts):
        if not len(g):
            continue
        names.append(int(bucket[g[0]]))
        blobs.append(_blob([ident[g], key[g], start[g]], b"\n".join([text[i] for i in g.tolist()])))
        held += len(blobs[-1])
        if held > 4 << 20:
            yield _rows(0, names, blobs)
            names, blobs, held = [], [], 0
    if names:
        yield _rows(0, names, blobs)


def super_kmers(texts: list[bytes], hot: np.ndarray, width: int = WIDTH, order: int = ORDER):
    """Super-k-mers of texts: minimiser, text number, first word (within the
    text) and packed string, as arrays, and the packed strings' hash."""
    buf, at = joined([b" ".join(t.split()) for t in texts])
    starts, ends = spans(buf, NOT_SPACE)
    if len(starts) < width:
        return None
    doc = np.searchsorted(at, starts, "right") - 1
    first_word = np.searchsorted(starts, at)
    gram = gram_hashes(span_hashes(buf, starts, ends), order)
    rank = (gram >> np.uint64(1)) | (hot[(gram & np.uint64(BINS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
    least = _sliding_min(rank, width - order + 1)
    at_word = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1:])
    if not len(at_word):
        return None
    own = least[at_word]
    new = np.ones(len(at_word), bool)
    new[1:] = (np.diff(at_word) != 1) | (own[1:] != own[:-1])
    run = np.arange(len(at_word)) - np.maximum.accumulate(np.where(new, np.arange(len(at_word)), 0))
    head = np.flatnonzero(new | (run % RUN == 0))
    tail = np.append(head[1:], len(at_word)) - 1
    a, b = at_word[head], at_word[tail] + width - 1
    raw = buf.tobytes()
    packed = [raw[i:j] for i, j in zip(starts[a].tolist(), ends[b].tolist())]
    return own[head], doc[a], a - first_word[doc[a]], packed, span_hashes(buf, starts[a], ends[b])


def _pack(hot_bits: bytes, width: int, order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(hot_bits, np.uint8)).astype(bool)
        s = _Strings()
        for batch in batches:
            for part in row_blocks(batch, "text"):
                got = super_kmers(text_bytes(part.column(2)), hot, width, order)
                if got is None:
                    continue
                mini, doc, start, packed, hashed = got
                ident, key = (part.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
                bucket = (mix64(mini) % np.uint64(buckets)).astype(np.int64)
                s.add(packed, bucket, hashed, ident, key, start, np.fromiter(map(len, packed), np.int64, len(packed)))
                if s.bytes > FLUSH:
                    yield from _flush(s, width, buckets)
                    s = _Strings()
        if s.text:
            yield from _flush(s, width, buckets)
    return run


def _windows(text: list[bytes], width: int):
    """Each window of the rows of ``text``, in order: its hash, row, first
    word, first byte and end byte (the last three within the row). Rows are
    read in pieces: arrays by word, the larger ones, are of one piece only."""
    cols = [[np.zeros(0, kind)] for kind in (np.uint64, *[np.int32] * 4)]
    stop = np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + 2 * PIECE, "right")))
        buf, at = joined(text[i:j])
        starts, ends = spans(buf, NOT_SPACE)
        if len(starts) >= width:
            doc = np.searchsorted(at, starts, "right") - 1
            first_word = np.searchsorted(starts, at)
            win = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1:])
            own = doc[win]
            got = (window_hashes(span_hashes(buf, starts, ends), width)[win], own + i, win - first_word[own],
                   starts[win] - at[own], ends[win + width - 1] - at[own])
            for c, x in zip(cols, got):
                c.append(x.astype(c[0].dtype, copy=False))
        i = j
    return [np.concatenate(c) for c in cols]


def repeats(ident: np.ndarray, key: np.ndarray, start: np.ndarray, text: list[bytes], width: int):
    """Runs of windows that occur earlier, as (ident, key, first word, end),
    of the super-k-mers of one bucket."""
    order = np.lexsort((start, key, ident))
    ident, key, start = ident[order], key[order], start[order]
    text = [text[i] for i in order.tolist()]
    h, own, word, lo, hi = _windows(text, width)
    place = start[own] + word
    by = np.argsort(h, kind="stable")
    head = np.ones(len(by), bool)
    head[1:] = h[by[1:]] != h[by[:-1]]
    first = np.empty(len(by), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    flagged = (first != np.arange(len(by)))
    flagged &= (ident[own] != ident[own[first]]) | (key[own] != key[own[first]]) | (place != place[first])
    idx = np.flatnonzero(first != np.arange(len(by)))
    if len(idx):                                              # the words themselves decide
        brk = np.flatnonzero((np.diff(idx) != 1) | (np.diff(first[idx]) != 1) | (np.diff(own[idx]) != 0)
                             | (np.diff(own[first[idx]]) != 0)) + 1
        a, b = idx[np.concatenate(([0], brk))], idx[np.append(brk, len(idx)) - 1]
        c, d = first[a], first[b]
        same = all(text[r][i:j] == text[s][k:m] for r, i, j, s, k, m in
                   zip(*(x.tolist() for x in (own[a], lo[a], hi[b], own[c], lo[c], hi[d]))))
        if not same:                                          # two windows with one hash: by dictionary
            seen: dict[bytes, int] = {}
            for i, (r, a, b) in enumerate(zip(own.tolist(), lo.tolist(), hi.tolist())):
                j = seen.setdefault(text[r][a:b], i)
                flagged[i] = (ident[own[i]], key[own[i]], place[i]) != (ident[own[j]], key[own[j]], place[j])
    idx = np.flatnonzero(flagged)
    if not len(idx):
        return None
    brk = np.flatnonzero((np.diff(idx) != 1) | (np.diff(own[idx]) != 0)) + 1
    ra, rb = idx[np.concatenate(([0], brk))], idx[np.append(brk, len(idx)) - 1]
    return ident[own[ra]], key[own[ra]], place[ra], place[rb] + width


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], bytes]] = []
        current = None

        def out(cols):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols],
                                              ["ident", "row_key", "word_from", "word_to"])

        def flush():
            ident, key, start = (np.concatenate([c[i] for c, _ in held]) for i in range(3))
            text = [t for _, x in held for t in x.split(b"\n")]
            held.clear()
            got = repeats(ident, key, start, text, width)
            del text
            release()
            if got is not None:
                yield out(got)

        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    yield out(_unblob(blob, 4)[0])
                    continue
                if bucket != current and held:
                    yield from flush()
                current = bucket
                held.append(_unblob(blob, 3))
        if held:
            yield from flush()
    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ident"),
                       F.xxhash64(text).alias("row_key"), text.alias("text"))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   order: int = ORDER) -> DataFrame:
    """``ident, row_key, word_from, word_to``: word ranges (end excluded)
    covered by windows whose words also start earlier. Ranges may overlap."""
    hot = np.packbits(hot_bins(docs, text_col, order)).tobytes()
    n = partitions(docs)
    buckets = 16 * n
    packed = (_prepared(docs, id_col, text_col).select("ident", "row_key", "text")
              .mapInArrow(_pack(hot, width, order, buckets), "bucket int, kind int, blob binary"))
    return (packed.repartition(n, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_count(width), "ident long, row_key long, word_from long, word_to long"))


def _ranges(docs: DataFrame, id_col: str, text_col: str, width: int, order: int) -> DataFrame:
    """``ident, row_key, lo, hi``: the ranges of ``repeated_words`` of one id
    and text, each once however many rows repeat them."""
    return (repeated_words(docs, id_col, text_col, width, order).groupBy("ident", "row_key")
            .agg(F.collect_set(F.struct("word_from", "word_to")).alias("part"))
            .select("ident", "row_key", F.col("part.word_from").alias("lo"), F.col("part.word_to").alias("hi")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_blocks(batch, "text"):
            out, sizes, removed = [], [], []
            for t, lo, hi in zip(text_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = t.split()
                sizes.append(len(words))
                if lo:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, lo, 1)
                    np.add.at(step, hi, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                removed.append(sizes[-1] - len(words))
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([b.decode() for b in out], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    order: int = ORDER) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text`` (the
    kept words joined by one space).

    Null and empty texts, and texts shorter than a window, lose nothing;
    repeated rows get a row each with the same result; a null id orders last;
    an empty table gives no rows; other columns are not read."""
    ranges = _ranges(docs, id_col, text_col, width, order)
    rows = _prepared(docs, id_col, text_col).join(ranges.hint("shuffle_hash"), ["ident", "row_key"], "left")
    return (rows.select("doc_id", "text", "lo", "hi")
            .mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string"))


def digest(kept: DataFrame) -> DataFrame:
    """The result with a SHA-256 of the kept text instead of the text."""
    return kept.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
