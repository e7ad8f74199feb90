"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds documents that contain at least ``threshold`` of the distinct five-word
shingles of a test item. Words are runs of ASCII letters and digits and of
other non-ASCII characters, A-Z lower-cased, so punctuation and case do not
hide a passage.

Documents are partitioned by the number of their distinct shingles: class c
has (2**(c-1), 2**c]. A class has one-permutation MinHash sketches of
8 * 2**c bins: a bin is named by the top bits of a shingle's hash and keeps the
least hash in it. An item's sketch is made for each class; a document and an
item are candidates if a bin of theirs holds the same value. A shingle that
both have fails this only if another one in its bin is smaller. The item has
no more than 1.25 times the document's shingles (else it cannot be contained),
so a bin's load is at most 2.25 / 8 and a shared shingle fails with
probability under 0.14. An item must share s = ceil(threshold * shingles); all
fail with 0.14 ** s. Where that is over ``MISS`` (items of under nine
shingles) further permutations are sketched until it is not.

Candidates are verified by exact containment: first by 64-bit shingle hashes
(which can only overstate it), then by the shingles' words.

Items are the stated query set: they go to the tasks in blocks of bounded
bytes, and every block meets all documents, each document inside one task.
Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ALNUM_CLASS, LOWER, gram_hashes, joined, mix64, row_blocks, span_hashes, spans, text_bytes
from docweave.llm.keep import drop_rows, row_key

WIDTH = 5
THRESHOLD = 0.8
MISS = 1e-6
BLOCK_BYTES = 16 << 20
_LOSS = 0.14
_BINS = 3                    # 8 bins for each shingle of the class


def words_of(text: bytes) -> list[bytes]:
    buf = LOWER[np.frombuffer(text, np.uint8)]
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(*(x.tolist() for x in spans(buf, ALNUM_CLASS)))]


def shingles(text: bytes, width: int) -> set[bytes]:
    w = words_of(text)
    return {b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)}


def size_class(n: int) -> int:
    return max(0, (n - 1).bit_length())


def permuted(h: np.ndarray, p: int) -> np.ndarray:
    return h if p == 0 else np.sort(mix64(h ^ np.uint64((0xA0761D6478BD642F * (2 * p + 1)) & ((1 << 64) - 1))))


def sketch(sorted_hashes: np.ndarray, cls: int) -> np.ndarray:
    """Least hash of each bin, of hashes in ascending order."""
    if not len(sorted_hashes):
        return sorted_hashes
    b = sorted_hashes >> np.uint64(64 - min(63, cls + _BINS))
    return sorted_hashes[np.concatenate(([True], b[1:] != b[:-1]))]


class Items:
    """Test items of one block, with their sketches for each class."""

    def __init__(self, rows: list[tuple[int, bytes]], width: int, threshold: float):
        self.threshold = threshold
        self.ids, self.texts, self.width, self.sets, self.perms = [], [], [], [], []
        for item_id, text in rows:
            n = len(words_of(text))
            if not n:
                continue
            w = min(width, n)
            buf = LOWER[np.frombuffer(text, np.uint8)]
            h = np.unique(gram_hashes(span_hashes(buf, *spans(buf, ALNUM_CLASS)), w))
            self.ids.append(item_id)
            self.texts.append(text)
            self.width.append(w)
            self.sets.append(h)
            self.perms.append(math.ceil(math.log(MISS) / (math.log(_LOSS) * max(1, math.ceil(threshold * len(h))))))
        self.widths = sorted(set(self.width))
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def n_perms(self, width: int) -> int:
        return max(p for p, w in zip(self.perms, self.width) if w == width)

    def table(self, width: int, cls: int, perm: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketch values of the items of one shingle width, sorted, and the item of each."""
        key = (width, cls, perm)
        if key not in self.tables:
            own = [i for i, w in enumerate(self.width) if w == width and self.perms[i] > perm]
            parts = [sketch(permuted(self.sets[i], perm), cls) for i in own]
            value = np.concatenate([*parts, np.zeros(0, np.uint64)])
            item = np.repeat(np.array(own, np.int64), [len(p) for p in parts])
            order = np.argsort(value, kind="stable")
            self.tables[key] = value[order], item[order]
        return self.tables[key]

    def candidates(self, h: np.ndarray, width: int) -> set[int]:
        """Items that share a bin's value with a document; ``h``: its distinct
        shingle hashes in ascending order."""
        cls = size_class(len(h))
        found: set[int] = set()
        for perm in range(self.n_perms(width)):
            value, item = self.table(width, cls, perm)
            own = sketch(permuted(h, perm), cls)
            lo = np.searchsorted(value, own, "left")
            hi = np.searchsorted(value, own, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                found.update(item[a:b].tolist())
        return found

    def matches(self, h: np.ndarray, width: int, text: bytes) -> Iterator[tuple[int, int, int]]:
        own = None
        for i in self.candidates(h, width):
            q = self.sets[i]
            at = np.minimum(np.searchsorted(h, q), len(h) - 1)
            if (h[at] == q).sum() < self.threshold * len(q) - 1e-9:
                continue
            own = shingles(text, width) if own is None else own
            item = shingles(self.texts[i], width)
            shared = len(item & own)
            if shared >= self.threshold * len(item) - 1e-9:
                yield i, len(item), shared


def _search(rows: list[tuple[int, bytes]], width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, width, threshold)
        for batch in batches:
            for part in row_blocks(batch, "text"):
                texts = text_bytes(part.column(2))
                buf, at = joined(texts)
                starts, ends = spans(LOWER[buf], ALNUM_CLASS)
                hashes = span_hashes(buf, starts, ends, LOWER)
                bound = np.append(np.searchsorted(starts, at), len(starts))
                ids, out = part.column(0), []
                for w in items.widths:
                    gram = gram_hashes(hashes, w)
                    for d, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
                        if b - a >= w:
                            h = np.unique(gram[a:b - w + 1])
                            out.extend((d, *m) for m in items.matches(h, w, texts[d]))
                if out:
                    d, i, n, s = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), part.column(1).take(pa.array(d)), pa.array([items.ids[k] for k in i], pa.int64()), pa.array(n, pa.int64()),
                         pa.array(s, pa.int64()), pa.array([x / y for x, y in zip(s, n)])],
                        ["doc_id", "row_key", "item_id", "n_shingles", "n_shared", "containment"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", width: int = WIDTH,
                 threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, row_key, item_id, n_shingles, n_shared, containment`` for every
    document row and item with containment of at least ``threshold``.

    An item of fewer than ``width`` words is one shingle of all its words.
    Null and empty texts match nothing; repeated rows give a row each; null
    ids are carried; an empty table gives no rows; other columns are not read."""
    item = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_bytes))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    found = []
    for b in range(blocks):
        own = item.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else item
        rows = [(r["item_id"], r["text"].encode()) for r in own.collect()]
        if rows and any(words_of(t) for _, t in rows):
            found.append(src.mapInArrow(_search(rows, width, threshold),
                                        "doc_id long, row_key long, item_id long, n_shingles long, n_shared long, containment double"))
    if not found:
        return src.selectExpr("doc_id", "row_key", "0L AS item_id", "0L AS n_shingles", "0L AS n_shared", "0D AS containment").limit(0)
    return reduce(DataFrame.union, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that contain no item; all columns stay. Null and
    empty texts contain none and stay; rows that repeat an id and a text share
    their fate, other rows with the id do not; a null id is a key like any
    other; without documents or items ``docs`` is returned as it is; columns
    may have any names."""
    hit = contaminated(docs, benchmark, id_col, text_col).select("doc_id", "row_key").distinct()
    return drop_rows(docs, id_col, text_col, hit)
