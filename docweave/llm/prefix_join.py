"""Jaccard self-join on distinct word shingles by a grouped prefix join.

All shingles have one global order: by how often documents hold them (a
sketch of counts by hash, over all documents), then by hash. Two sets whose
similarity reaches the threshold share a shingle among their first ``n -
ceil(threshold * n) + 1`` in that order, their prefixes, whatever the order
is; rare shingles first keep the lists short.

1. Documents with one shingle set are one unit; units with identical prefix
   and size are one group. Only groups are posted under their prefix shingles.
2. Group pairs of a list are filtered by size, by position (before the first
   shared shingle nothing is shared, so what follows bounds the overlap; most
   rows pass with no other of their list and go before anything else), and
   by bitmaps: a set's bitmap has a bit for each of 512 hash classes, flipped
   by every shingle in it, so two sets differ in at least as many shingles as
   their bitmaps in bits. No filter loses a pair.
3. Pairs that pass are expanded to their member units, whose whole sets are
   compared exactly.

Classes need no all-pairs output. In a round every list gives a spanning
forest of the pairs that pass, between classes known so far, from its group
with the smallest hash on; so the lists of one family of near copies give
mostly the same pairs. What these link is contracted. After ``FORESTS`` such
rounds all pairs left between different classes of a list are taken, so no
link between classes is lost. A list with more than ``hot`` entries is cut
into chunks and every pair of chunks is a list of its own.

Shingles are known by 64-bit hashes, sets and prefixes by 128 bits. Sets are
computed from the text again for the units that are compared, so what is
staged is a tenth of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import LOWER, NOT_SPACE, components, discard, gram_hashes, joined, mix64, partitions, row_blocks, small, span_hashes, spans, stage, stage_by, text_bytes
from docweave.llm.keep import row_key
from docweave.llm.vectors import row_pieces

SHINGLE = 3
#: A link needs 100 * intersection >= 90 * union.
PART, WHOLE = 90, 100
#: Counters of the sketch. Its size is the same at every input; with more
#: shingles than counters only the order is coarser, not the result.
BUCKET_BITS = 22
_CHUNK = 1 << 13
HOT = 1024
#: Rounds of spanning forests before all pairs left are taken.
FORESTS = 2
BITS = 512
#: Bits of the filter of rows whose sets are wanted (2 MB).
MARK_BITS = 24
_MARKS = 1 << 16
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


# ---------------------------------------------------------------- shingle sets

def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, and each text's first place
    among them (one place more than texts); rising hashes in a text."""
    buf, begin = joined(texts)
    s, e = spans(buf, NOT_SPACE)
    words = span_hashes(buf, s, e, LOWER)
    own = np.searchsorted(begin, s, "right") - 1
    n = np.bincount(own, minlength=len(texts))
    grams = gram_hashes(words, width)
    inside = own[: len(grams)] == own[width - 1:] if len(grams) else np.zeros(0, bool)
    h, doc = [grams[inside]], [own[: len(grams)][inside]]
    first = np.concatenate(([0], np.cumsum(n)))
    for few in range(1, width):                     # the whole sequence is one shingle
        short = np.flatnonzero(n == few)
        if len(short):
            runs = words[first[short][:, None] + np.arange(few)]
            h.append(np.array([gram_hashes(r, few)[0] for r in runs], np.uint64))
            doc.append(short)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def _names(h: np.ndarray, cut: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16-byte name of each run of hashes, whatever their order, and of ``n``."""
    out = np.empty((len(n), 2), np.uint64)
    for k in (0, 1):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ _SALT[k]))))
        out[:, k] = mix64(sums[cut[1:]] - sums[cut[:-1]] + n.astype(np.uint64) * _SALT[1 - k])
    whole = out.tobytes()
    return [whole[i:i + 16] for i in range(0, len(whole), 16)]


def _cells(h: np.ndarray, cut: np.ndarray) -> pa.Array:
    raw = h.tobytes()
    return pa.array([raw[8 * a:8 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for part in row_blocks(batch, "text"):
            yield part, *shingle_sets(text_bytes(part.column(part.schema.get_field_index("text"))), width)


# ---------------------------------------------------------------- order of shingles

def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], np.zeros(1 << BUCKET_BITS, np.uint32)

        def add():
            np.add(total, np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32), out=total)
            held.clear()
        for _, h, _ in _blocks(batches, width):
            held.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            if sum(map(len, held)) > 1 << 21:
                add()
        if held:
            add()
        chunks = total.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        planes = [np.ascontiguousarray(chunks[i].view(np.uint8).reshape(-1, 4).T).tobytes() for i in used]     # bytes of one rank together: mostly zeros
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(planes, pa.binary())], ["chunk", "counts"])
    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, None

    def row():
        level = np.frexp(total.astype(np.float64))[1].astype(np.uint8)          # bits of the count
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "levels"])
    for batch in batches:
        for chunk, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0].astype(np.int64)
            if chunk != at:
                if at is not None:
                    yield row()
                at, total = chunk, np.zeros(_CHUNK, np.int64)
            total += counts
    if at is not None:
        yield row()


def shingle_levels(docs: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """Bits of the number of documents (repeated rows count again) whose
    shingles fall into each bucket, over all of ``docs`` (column ``text``)."""
    parts = docs.select("text").mapInArrow(_count(width), "chunk int, counts binary")
    rows = (parts.repartition(partitions(docs), "chunk").sortWithinPartitions("chunk")
            .mapInArrow(_sum_chunks, "chunk int, levels binary").collect())          # 1 << BUCKET_BITS bytes
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in rows:
        out[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return out


# ---------------------------------------------------------------- units, groups, postings

def prefix_length(n, part: int = PART, whole: int = WHOLE):
    """Shingles of a set of ``n`` among which it shares one with every partner."""
    return n - -(-n * part // whole) + 1


def bitmaps(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """``BITS`` bits (as bytes) of each run of hashes: the parity of each class."""
    n = len(cut) - 1
    cell = np.repeat(np.arange(n), np.diff(cut)) * BITS + (h & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def _describe(width: int, levels: np.ndarray, part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, cut in _blocks(batches, width):
            n = np.diff(cut)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, levels[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], doc))
            place = np.arange(len(h)) - cut[doc]
            length = np.where(n > 0, prefix_length(n, part, whole), 0)
            prefix = h[order][place < length[doc]]
            p_cut = np.concatenate(([0], np.cumsum(length)))
            bits = [b.tobytes() for b in bitmaps(h, cut)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n.astype(np.int32)), pa.array(_names(h, cut, n), pa.binary()),
                                              pa.array(_names(prefix, p_cut, n), pa.binary()), pa.array(bits, pa.binary()), _cells(prefix, p_cut)],
                                             ["doc_id", "row_key", "n", "uid", "gkey", "bits", "prefix"])
    return run


def _post(levels: np.ndarray, hot: int):
    """``token, g, n, pos, often``: a row for each prefix shingle of a group;
    only a shingle that is ``often`` can have a list longer than ``hot``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_pieces(batches, 1 << 12):
            prefix = part.column(2).to_pylist()
            size = np.fromiter((len(p) // 8 for p in prefix), np.int64, len(prefix))
            row = pa.array(np.repeat(np.arange(len(prefix)), size))
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            token = np.frombuffer(b"".join(prefix), np.uint64)
            often = levels[(token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] >= hot.bit_length()
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), part.column(0).take(row), part.column(1).take(row),
                                              pa.array(pos.astype(np.int32)), pa.array(often)], ["token", "g", "n", "pos", "often"])
    return run


# ---------------------------------------------------------------- exact comparison

def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chunk, marks``: a bit for each place of each chunk; rows come sorted by chunk."""
    for batch in _by_list(batches, ("chunk",)):
        chunk, at = (c.to_numpy() for c in batch.columns)
        first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        bits = np.zeros((len(first), _MARKS), np.uint8)
        bits[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(chunk)))), at] = 1
        rows = [r.tobytes() for r in np.packbits(bits, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(rows, pa.binary())], ["chunk", "marks"])


def _marked(keys: DataFrame) -> np.ndarray:
    """Bits (as bytes) of the classes of ``row_key`` that ``keys`` has. The
    size is fixed: with very many keys it only lets more rows pass."""
    place = F.pmod("row_key", F.lit(1 << MARK_BITS))
    rows = keys.select(F.shiftright(place, _MARKS.bit_length() - 1).cast("int").alias("chunk"), F.pmod(place, F.lit(_MARKS)).cast("int").alias("at")).distinct()
    rows = rows.repartition(partitions(keys), "chunk").sortWithinPartitions("chunk").mapInArrow(_marks, "chunk int, marks binary")
    out = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    step = _MARKS // 8
    for r in rows.collect():                               # 1 << MARK_BITS bits
        out[r["chunk"] * step:(r["chunk"] + 1) * step] = np.frombuffer(r["marks"], np.uint8)
    return out


def _sets(width: int, marks: np.ndarray):
    """``doc_id, row_key, hashes`` of the rows whose key may be wanted."""
    def wanted(batches):
        seen = set()                                       # of a document's many rows a task gives one
        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64) & np.uint64((1 << MARK_BITS) - 1)
            batch = batch.filter(pa.array(((marks[(key >> np.uint64(3)).astype(np.int64)] >> (7 - (key & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)))
            new = []
            for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(new, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, cut in _blocks(wanted(batches), width):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _cells(h, cut)], ["doc_id", "row_key", "hashes"])
    return run


def _linked(part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = whole * shared >= part * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


class _Verifier:
    """Compares unit pairs; keeps the staged sets of units met before."""

    def __init__(self, docs: DataFrame, units: DataFrame, width: int, part: int, whole: int):
        self.docs, self.units, self.width, self.part, self.whole = docs, units, width, part, whole
        self.sets: list[DataFrame] = []

    def all_sets(self) -> DataFrame:
        return reduce(DataFrame.union, self.sets)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Links ``(a, b)`` among staged unit pairs."""
        need = stage(pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct())
        new = need.join(self.all_sets().select("u"), "u", "left_anti") if self.sets else need
        reps = stage(self.units.join(small(new) if new is need else new, "u", "left_semi").select("u", "rep.doc_id", "rep.row_key"))
        made = self.docs.mapInArrow(_sets(self.width, _marked(reps)), "doc_id long, row_key long, hashes binary")
        at = made["doc_id"].eqNullSafe(reps["doc_id"]) & (made["row_key"] == reps["row_key"])
        made = made.join(small(reps), at).select("u", "hashes").repartition(partitions(made), "u")
        self.sets.append(stage_by(made.groupBy("u").agg(F.first("hashes").alias("hashes")), "u"))          # a document may be rows of several tasks
        sets = self.all_sets().join(small(need), "u", "left_semi")
        both = (sets.select(F.col("u").alias("a"), F.col("hashes").alias("x")).join(small(pairs), "a")
                .join(sets.select(F.col("u").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y"))
        out = stage(both.mapInArrow(_linked(self.part, self.whole), "a long, b long"))
        discard(need, reps)
        return out


# ---------------------------------------------------------------- pairs between classes

def _by_list(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of whole lists, of rows sorted by ``keys``."""
    held: pa.Table | None = None                          # rows from the last, still open, list on
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        edge = np.zeros(max(0, rows.num_rows - 1), bool)
        for k in keys:
            v = rows[k].to_numpy()
            edge |= v[1:] != v[:-1]
        cut = np.flatnonzero(edge)
        last = int(cut[-1]) + 1 if len(cut) else 0
        held = rows.slice(last)
        if last:
            yield rows.slice(0, last).combine_chunks().to_batches()[0]
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def _useful(part: int, whole: int):
    """Rows of each list (sorted by ``token``) that pass the size and position
    filters with another row of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_list(batches, ("token",)):
            token, n, pos = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3))
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(start, len(token)))

            def fit(i, j):
                a, b = n[i], n[j]
                return ((np.minimum(a, b) * whole >= np.maximum(a, b) * part)
                        & (np.minimum(a - pos[i], b - pos[j]) * (part + whole) >= part * (a + b)))
            keep = np.zeros(len(token), bool)
            two = start[size == 2]
            two = two[fit(two, two + 1)] if len(two) else two
            keep[two] = keep[two + 1] = True
            for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                own = np.arange(s, s + m)
                both = fit(own[:, None], own[None, :])
                np.fill_diagonal(both, False)
                keep[own] = both.any(axis=1)
            yield batch.filter(pa.array(keep))
    return run


class _Filter:
    """Which pairs of a list's entries differ in class and may link."""

    def __init__(self, n, pos, comp, bits, part: int, whole: int):
        self.n, self.pos, self.comp, self.bits, self.part, self.whole = n, pos, comp, bits, part, whole
        self.plain = ~bits.any(axis=1)                   # several sets in one entry: no bitmap

    def passing(self, i, j) -> np.ndarray:
        a, b = self.n[i], self.n[j]
        room = np.minimum(a - self.pos[i], b - self.pos[j])
        ok = ((np.minimum(a, b) * self.whole >= np.maximum(a, b) * self.part)
              & (room * (self.part + self.whole) >= self.part * (a + b)) & (self.comp[i] != self.comp[j]))
        differ = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=-1, dtype=np.int64)
        return ok & (((a + b - differ) * (self.part + self.whole) >= 2 * self.part * (a + b)) | self.plain[i] | self.plain[j])

    def all_pairs(self, s: int, m: int) -> list:
        i, j = np.triu_indices(m, 1)
        ok = self.passing(s + i, s + j)
        return [(s + i[ok], s + j[ok])]

    def forest(self, s: int, m: int) -> list:
        """Spanning forest between classes, from the first entry on."""
        out, left = [], np.arange(s, s + m)
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                u = queue.pop()
                same = self.comp[left] == self.comp[u]
                near = self.passing(u, left)
                got = left[near]
                if len(got):
                    got = got[np.unique(self.comp[got], return_index=True)[1]]
                    out.append((np.full(len(got), u), got))
                    near |= np.isin(self.comp[left], self.comp[got])
                reached = near | same
                queue.extend(left[reached].tolist())
                left = left[~reached]
        return out


def _cross(part: int, whole: int, forest: bool):
    """Pairs of entries of each list (rows sorted by ``token``, ``sub``) that pass the filters."""
    def pairs(batch):
        token, sub, n, pos, g, comp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        bits = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(len(token), -1)
        keep = _Filter(n.astype(np.int64), pos.astype(np.int64), comp, bits, part, whole)
        start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (sub[1:] != sub[:-1]))))
        size = np.diff(np.append(start, len(token)))
        two = start[size == 2]
        two = two[keep.passing(two, two + 1)] if len(two) else two
        found = [(two, two + 1)]
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            found += keep.forest(s, m) if forest else keep.all_pairs(s, m)
        i, j = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g[i], comp[i], g[j], comp[j])], ["ga", "ca", "gb", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_list(batches, ("token", "sub")):
            yield pairs(batch)
    return run


def _between(lists: DataFrame, entry: DataFrame, hot: int, part: int, whole: int, forest: bool) -> DataFrame:
    """``(ga, ca, gb, cb)``: pairs of (group, class) entries of one list that
    differ in class and pass the filters: a forest of them, or all."""
    rows = lists.join(entry.select("g", "comp"), "g")
    mixed = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    rows = rows.join(mixed.select("token", "m"), "token")
    k = F.when(F.col("m") > hot, F.ceil(F.col("m") / (hot / 2))).otherwise(F.lit(1)).cast("long")
    rows = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("g", "comp"), F.col("k")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("token", (F.least("own", "other") * F.col("k") + F.greatest("own", "other")).alias("sub"), "n", "pos", "g", "comp")
    rows = rows.join(entry.select("g", "comp", "bits"), ["g", "comp"]).select("token", "sub", "n", "pos", "g", "comp", "bits", F.xxhash64("g").alias("h"))
    rows = rows.repartition(partitions(lists), "token", "sub").sortWithinPartitions("token", "sub", "h", "comp").drop("h")
    return rows.mapInArrow(_cross(part, whole, forest), "ga long, ca long, gb long, cb long")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    part: int = PART, whole: int = WHOLE, hot: int = HOT) -> DataFrame:
    """``doc_id, row_key, n_shingles, label, component_id``: one row for each
    row of ``docs``; classes of documents that links (``whole * intersection
    >= part * union`` of the shingle sets) reach, named by the smallest id.

    Null and empty texts and texts without words have no shingles: they are
    linked with nothing, repeated ones included, and name themselves (their
    ``label`` is null). A text of fewer than ``width`` words is one shingle.
    Repeated rows and texts with one set are one class. A null id takes part,
    but names a class only where no row of it has an id. An empty table gives
    no rows; other columns are not read."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    levels = shingle_levels(src, width)
    known = stage(src.mapInArrow(_describe(width, levels, part, whole), "doc_id long, row_key long, n int, uid binary, gkey binary, bits binary, prefix binary"))
    some = known.filter("n > 0")
    named = some.groupBy("uid").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_key")).alias("rep"), F.first("n").alias("n"),
                                    F.first("gkey").alias("gkey"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    units = stage(named.withColumn("u", F.monotonically_increasing_id()))              # written once: the numbers stay
    every = stage(known.select("doc_id", "row_key", "n", "uid"))
    discard(known)
    several = stage(units.groupBy("gkey").agg(F.count("*").alias("units"), F.min("u").alias("g")).filter("units > 1"))
    groups = stage(units.join(several, "gkey", "left").select("u", F.coalesce("g", "u").alias("g"), F.coalesce("units", F.lit(1)).alias("units"), "n", "bits"))
    others = small(stage(groups.filter("u <> g").select("u")))
    posts = units.join(others, "u", "left_anti").select(F.col("u").alias("g"), "n", "prefix").mapInArrow(_post(levels, hot), "token long, g long, n int, pos int, often boolean")
    long = stage(posts.filter("often").groupBy("token").count().filter(F.col("count") > hot).select("token"))
    posts = posts.drop("often")
    brief = posts if long.isEmpty() else posts.join(long, "token", "left_anti")
    lists = (brief.repartition(partitions(src), "token").sortWithinPartitions("token", "g")
             .mapInArrow(_useful(part, whole), "token long, g long, n int, pos int"))
    if not long.isEmpty():
        lists = lists.unionByName(posts.join(long, "token", "left_semi"))
    # the members of a group are a list too, under a number of its own below all shingles' places
    inner = groups.filter("units > 1 and u = g").select(F.xxhash64("g").alias("token"), "g", "n", F.lit(0).alias("pos"))
    lists = stage(lists.unionByName(inner))
    names = stage(units.select("u", "uid", "least", "rep"))
    discard(units)
    verify = _Verifier(src, names, width, part, whole)
    seen, links = [], []
    comps = groups.select("u", "g", "units", "bits", F.col("u").alias("comp"))
    for turn in range(FORESTS + 1):
        # a group in a list: an entry for each class in it; the bitmap of a single member stands for it
        entry = comps.groupBy("g", "comp").agg(F.count("*").alias("c"), F.first("bits").alias("bits"), F.min("u").alias("one"))
        entry = stage(entry.select("g", "comp", F.when(F.col("c") == 1, F.col("bits")).otherwise(F.lit(bytes(BITS // 8))).alias("bits"), "one"))
        found = _between(lists, entry, hot, part, whole, forest=turn < FORESTS).distinct()
        if turn < FORESTS:          # one member of each side
            pairs = (found.join(entry.select(F.col("g").alias("ga"), F.col("comp").alias("ca"), F.col("one").alias("ua")), ["ga", "ca"])
                     .join(entry.select(F.col("g").alias("gb"), F.col("comp").alias("cb"), F.col("one").alias("ub")), ["gb", "cb"]))
        else:                       # every member
            side = comps.select("u", "g", "comp", "bits")
            pairs = (found.join(side.select(F.col("u").alias("ua"), F.col("g").alias("ga"), F.col("comp").alias("ca")), ["ga", "ca"])
                     .join(side.select(F.col("u").alias("ub"), F.col("g").alias("gb"), F.col("comp").alias("cb")), ["gb", "cb"]))
        pairs = pairs.select(*_ordered(F.col("ua"), F.col("ub"))).distinct()
        for old in seen:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = stage(pairs)
        seen.append(pairs)
        if not pairs.isEmpty():
            links.append(verify(pairs))
            label = stage(components(reduce(DataFrame.union, links)))
            comps = stage(groups.select("u", "g", "units", "bits").join(label, groups["u"] == label["node"], "left")
                          .select("u", "g", "units", "bits", F.coalesce("label", "u").alias("comp")))
    called = names.select("u", "uid", "least").join(comps.select("u", "comp"), "u")
    low = called.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = stage(called.join(low, "comp").select("uid", F.col("comp").alias("label"), "component_id"))
    discard(*seen, *links, *verify.sets, lists, long, groups, several, names)
    full = every.filter("n > 0").join(classes, "uid").select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "label", "component_id")
    none = every.filter("n = 0").select("doc_id", "row_key", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return full.union(none)
