"""Token ids of documents in binary shards, coded with Simple-8b.

File format. A data set is a folder of Parquet files, written by Spark's own
committed writer, so a lost executor leaves no half file. Each row is a page
of whole documents of one shard: ``shard``, ``page``, ``first`` (ids of the
shard before the page), ``n_ids``, the coded ids (``words``, ``escapes``, and
the per-block offsets ``word_at``, ``escape_at`` and ``cap``), all little
endian, and the documents' ids and lengths. Shards are ranges of doc_id in
ascending order (nulls first) and documents ascend within them, so shard,
page and place in the page give the order of the whole data set.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm import simple8b
from docweave.llm.common import cuts, partitions, release, row_blocks

END_ID = 0
PAGE = 1 << 20
MEMO = 500_000
TEXT = 4 << 20
#: Bytes of text whose pieces are looked up together.
LOOKUP = 4 * TEXT
#: Pieces that go to the library at a time when they cannot share a text.
ALONE = 10_000
#: In front of a piece that has no space before it (private use character).
MARK = "\ue000"
#: A letter, and the punctuation that follows it up to the word's end.
_TAIL = r"(\pL)([^\pL\pN\s\pZ\x{85}\x{b}\x{1c}-\x{1f}]+(?: |$))"
_CUT = re.compile(r"(?<=\S)(?= \S)")
PAGES = ("shard int, page long, first long, n_ids long, words binary, word_at binary, cap binary, "
         "escapes binary, escape_at binary, doc_ids array<long>, doc_sizes array<long>")


def cut_texts(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cut texts where the byte-level pre-tokeniser always cuts: before a
    space that no space or line feed adjoins, before such a line feed (of a
    run of white space the pre-tokeniser leaves the last character to what
    follows, so a tab in front does no harm), and between a letter and other
    visible characters that end a word.

    Returns the pieces of all texts one after the other, the number of pieces
    of each text, and which texts were left out: empty ones, and those with
    other runs of spaces and line feeds, the mark or a special string. A piece
    is returned without its leading space; one that begins with a line feed
    is complete; so is one marked by ``MARK`` in front, and the first piece of
    a text."""
    spaced = pc.replace_substring(texts, "\n", " \n")
    odd = pc.or_(pc.match_substring(spaced, "  "), pc.match_substring(spaced, "\n "))
    for f, mark in ((pc.starts_with, " "), (pc.ends_with, " "), (pc.ends_with, "\n"),
                    *((pc.match_substring, x) for x in (MARK, *specials))):
        odd = pc.or_(odd, f(spaced, mark))
    odd = pc.or_(odd, pc.equal(spaced, "")).to_numpy(zero_copy_only=False)
    tails = pc.replace_substring_regex(spaced.filter(pa.array(~odd)), _TAIL, "\\1 " + MARK + "\\2")
    parts = pc.split_pattern(tails, " ")
    count = np.zeros(len(texts), np.int64)
    count[~odd] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return parts.flatten(), count, odd


def odd_pieces(text: str) -> list[str]:
    """Pieces of a text with other white space: cut before lone spaces only,
    each complete and marked."""
    return [MARK + p for p in _CUT.split(text)]


def _spelled(piece: str) -> str:
    if piece[0] == MARK:
        return piece[1:]
    return piece if piece[0] == "\n" else " " + piece


def _strings(pieces: pa.Array) -> list[str]:
    """Pieces without spaces in them as Python strings, cut from one."""
    if not len(pieces):
        return []
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), pa.scalar(" ", pa.large_string()))
    return whole[0].as_py().split(" ")


def _take(at: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of these rows of the memo one after the other, and the count of each."""
    size = (at[1:] - at[:-1])[rows]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[:-1][rows] - (ends - size), size)], size


class Encoder:
    """Encodes texts with the ``tokenizers`` library, each distinct piece of
    a batch once; from one batch to the next, ids of at most ``memo`` pieces are kept.

    A word of letters alone is one pre-token, so it goes to the library's
    model as it is; which characters are letters, and how the model spells
    them, the library's pre-tokeniser says, once for each character. Every
    other piece goes through the whole library."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        cut = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
               and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
               and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                           for t in spec.get("added_tokens", [])))
        self.cut = cut
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if cut and len(line) == 1 else None
        self.model, self.pre = self.tok.model, self.tok.pre_tokenizer
        #: Model's spelling of the letters seen so far; characters that only Python takes for letters.
        self.spelling: dict[str, str] = {}
        self.foreign: set[str] = set()
        self.space = self.pre.pre_tokenize_str(" ")[0][0] if self.line is not None else ""
        self.memo = memo
        self._clear()

    def _clear(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.at, self.flat, self.uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the half of the memo that most batches have used."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.memo // 2])
        self.flat, size = _take(self.at, self.flat, keep)
        self.at, self.uses = np.concatenate(([0], np.cumsum(size))), self.uses[keep] // 2
        self.keys = self.keys.take(pa.array(keep))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[str]) -> list[tuple[str, str, str]]:
        """The pieces that are a word of letters alone, with what is in front
        (a space as the model spells it, a line feed or nothing) and the word.
        Texts with a special string come in marked pieces; these are left out
        if such a string could stand in a word."""
        if self.line is None:
            return []
        words = [(p, self.space, p) for p in new if p.isalpha()]
        words += [(p, "\n", p[1:]) for p in new if p[0] == "\n" and p[1:].isalpha()]
        if not any(x.isalpha() for x in self.specials):
            words += [(p, "", p[1:]) for p in new if p[0] == MARK and p[1:].isalpha()]
            words += [(p, self.space, p[2:]) for p in new if p[:2] == MARK + " " and p[2:].isalpha()]
        for c in set("".join(w for _, _, w in words)).difference(self.spelling, self.foreign):
            got = self.pre.pre_tokenize_str(f"a{c}a")
            if len(got) == 1:
                self.spelling[c] = got[0][0][1:-1]
            else:
                self.foreign.add(c)
        return [x for x in words if self.foreign.isdisjoint(x[2])] if self.foreign else words

    def _learn(self, new: list[str]) -> dict[str, int]:
        """Encode new, different pieces: words by the model, the others many
        to a call; there a line feed between two pieces is a token of its own,
        at which the ids fall apart again. Returns the row of each."""
        words = self._words(new)
        known = [p for p, _, _ in words]
        rest = list(set(new).difference(known))
        joint = [p for p in rest if self.line is not None and p[0] != MARK and not p[-1].isspace()
                 and not p[p[0] == "\n"].isspace()]
        alone = list(set(rest).difference(joint))
        feeds = [p for p in joint if p[0] == "\n"]
        plain = [p for p in joint if p[0] != "\n"]
        lumps = [("".join(feeds[i:i + 500]), 0) for i in range(0, len(feeds), 500)]
        lumps += [("\n " + "\n ".join(plain[i:i + 500]), 1) for i in range(0, len(plain), 500)]
        table, tokens, line = str.maketrans(self.spelling), self.model.tokenize, [self.line]
        size, flat = [], []
        for _, front, word in words:
            if not word.isascii():
                word = word.translate(table)
            if front == "\n":
                got = line + [t.id for t in tokens(word)]
            else:
                got = [t.id for t in tokens(front + word)]
            size.append(len(got))
            flat += got
        for i in range(0, len(alone), ALONE):
            for ids in self._ids([_spelled(p) for p in alone[i:i + ALONE]]):
                size.append(len(ids))
                flat += ids
        size, flat = [np.array(size, np.int64)], [np.array(flat, np.uint32)]
        for (_, skip), ids in zip(lumps, self._ids([x for x, _ in lumps])):
            ids = np.array(ids, np.uint32)
            first = np.flatnonzero(ids == self.line)
            size.append(np.diff(np.append(first, len(ids))) - skip)
            flat.append(np.delete(ids, first) if skip else ids)
        new = known + alone + feeds + plain
        size = np.concatenate(size)
        base = len(self.keys)
        self.keys = pa.concat_arrays([self.keys, pa.array(new, pa.large_string())])
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        self.flat = np.concatenate((self.flat, *flat))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        return dict(zip(new, range(base, base + len(new))))

    def _rows(self, pieces: pa.Array, extra: list[str]) -> np.ndarray:
        """Row of each piece and extra piece, learning the new ones."""
        every = pa.concat_arrays([pieces, pa.array(extra, pa.large_string())])
        at = pc.index_in(every, value_set=self.keys)
        rows = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            own = np.searchsorted(unknown, len(pieces))
            new = _strings(pieces.take(pa.array(unknown[:own]))) + [extra[i - len(pieces)] for i in unknown[own:].tolist()]
            row = self._learn(list(dict.fromkeys(new)))
            rows[unknown] = np.fromiter(map(row.__getitem__, new), np.int64, len(new))
        self.uses[rows] += 1
        return rows

    def _pieces(self, texts: pa.Array, extra: dict[str, int]):
        """Coded pieces of the texts, their number by text, which texts are
        odd, place and number in ``extra`` of the first piece of each other
        text, and the numbers of the odd ones' pieces."""
        if self.cut:
            flat, count, odd = cut_texts(texts, self.specials)
        else:
            flat, count, odd = texts.slice(0, 0), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        first = np.cumsum(count[~odd]) - count[~odd]
        heads = [extra.setdefault(MARK + p, len(extra)) for p in _strings(flat.take(pa.array(first)))]
        rest = [np.zeros(0, np.int64)]
        for k in np.flatnonzero(odd).tolist():
            if text := texts[k].as_py():
                got = odd_pieces(text) if self.cut else [MARK + text]
                count[k] = len(got)
                rest.append(np.array([extra.setdefault(p, len(extra)) for p in got], np.int64))
        return flat.dictionary_encode(), count, odd, first, np.array(heads, np.int64), np.concatenate(rest)

    def blocks(self, texts: pa.Array, limit: int = TEXT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of one slice of the texts after the other (at most
        ``limit`` bytes or one text); pieces are looked up for all at once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        extra: dict[str, int] = {}
        parts = [self._pieces(texts.slice(i, j - i), extra) for i, j in cuts(texts, limit)]
        if not parts:
            return
        coded = pa.chunked_array([p[0] for p in parts]).unify_dictionaries().chunks
        row = self._rows(coded[0].dictionary, list(extra))
        of = row[len(row) - len(extra):]
        for k, (_, count, odd, first, heads, rest) in enumerate(parts):
            code = row[coded[k].indices.to_numpy(zero_copy_only=False)]
            code[first] = of[heads]
            stop = np.cumsum(count)
            if len(rest):
                own, code, is_odd = code, np.empty(stop[-1], np.int64), np.repeat(odd, count)
                code[~is_odd] = own
                code[is_odd] = of[rest]
            ids, size = _take(self.at, self.flat, code)
            before = np.concatenate(([0], np.cumsum(size)))
            yield ids, before[stop] - before[stop - count]
        if len(self.keys) > self.memo:
            self._shrink()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the count of each."""
        got = [(np.zeros(0, np.uint32), np.zeros(0, np.int64)), *self.blocks(texts)]
        return np.concatenate([ids for ids, _ in got]), np.concatenate([size for _, size in got])


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _writer(path: str, end_id: int, page_ids: int):
    def page(shard: int, number: int, first: int, ids: np.ndarray, doc_ids: list, sizes: np.ndarray) -> pa.RecordBatch:
        c = simple8b.encode(ids)
        blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()),
             pa.array([len(ids)], pa.int64()), blob(c.words, "<u8"), blob(c.word_at, "<i4"), blob(c.cap, "u1"),
             blob(c.escapes, "<u4"), blob(c.escape_at, "<i4"), pa.array([doc_ids], pa.list_(pa.int64())),
             pa.array([sizes.tolist()], pa.list_(pa.int64()))],
            [f.split()[0] for f in PAGES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard = TaskContext.get().partitionId()
        number = first = 0
        held, docs, sizes = [], [], []

        def flush():
            nonlocal number, first
            ids = np.concatenate(held)
            out = page(shard, number, first, ids, docs.copy(), np.concatenate(sizes))
            number, first = number + 1, first + len(ids)
            for x in (held, docs, sizes):
                x.clear()
            return out

        for batch in batches:
            for part in row_blocks(batch, "text", LOOKUP):
                at = 0
                for ids, size in _encoder(path).blocks(part.column(1)):
                    held.append(np.insert(ids, np.cumsum(size), np.uint32(end_id)))
                    docs.extend(part.column(0).slice(at, len(size)).to_pylist())
                    sizes.append(size + 1)
                    at += len(size)
                    if sum(map(len, held)) >= page_ids:
                        yield flush()
        if held:
            yield flush()
        release()
    return run


def write_token_ids(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int = END_ID, page_ids: int = PAGE) -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each, and
    write the pages under ``out``. Rows with the same id follow each other in
    the order of a hash of their texts; null ids come first; an empty table
    gives an empty data set; other columns are not read."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    n = partitions(docs)
    (src.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
     .mapInArrow(_writer(tokenizer, end_id, page_ids), PAGES).write.parquet(out))


def _coded(row: dict) -> simple8b.Coded:
    a = lambda k, kind: np.frombuffer(row[k], kind)
    return simple8b.Coded(a("words", "<u8"), a("word_at", "<i4"), a("cap", "u1"), a("escapes", "<u4"),
                          a("escape_at", "<i4"), row["n_ids"])


def _with_start(pages: DataFrame) -> DataFrame:
    """Pages with ``before``: ids of the data set before the page. One row a
    shard is broadcast; shards are partitions of the writing job."""
    total = pages.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    run = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("shard", F.coalesce(F.sum("ids").over(run), F.lit(0)).alias("base"))
    return pages.join(F.broadcast(base), "shard").withColumn("before", F.col("base") + F.col("first")).drop("base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(_coded(row))
                ends = np.cumsum(np.array(row["doc_sizes"], np.int64))
                starts = ends - row["doc_sizes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"]),
                     pa.ListArray.from_arrays(np.append(starts, ends[-1:]).astype(np.int32), pa.array(ids.astype(np.int64)))],
                    ["doc_id", "start", "ids"])

    return _with_start(spark.read.schema(PAGES).parquet(path)).mapInArrow(run, "doc_id long, start long, ids array<long>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the
    decoded ids (unsigned CRC-32 of them as little-endian 32-bit integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = memoryview(simple8b.decode(_coded(row)).astype("<u4").tobytes())
                size = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(size)
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - size + row["before"]), pa.array(size),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                del row, raw
            release()

    pages = _with_start(spark.read.schema(PAGES).parquet(path))
    return pages.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
