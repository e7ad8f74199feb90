"""Token counts with a whole-token shortcut.

Text falls into pre-tokens at places where no merge of the vocabulary can
reach across. ``whole_tokens`` proves offline, with the library itself, which
vocabulary strings encode alone as one token; a pre-token among them counts 1
without being merged. Only the remaining distinct pre-tokens of a batch go
through the library, and their counts are kept in a bounded memo.

SentencePiece (``.model``): a space is the character U+2581, one is put in
front of the text, and no vocabulary string has U+2581 after another
character or holds a line feed (checked when the model is loaded; texts of another model are counted whole).
So a run of spaces
with the word after it is one pre-token, and a line feed with the characters
after it is another.

Byte-level BPE (``.json``): see ``token_ids.cut_texts``.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import row_blocks

LIMIT = 4096
MEMO = 200_000
_BAR = "▁"
_RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")


@functools.lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether no merge can cross the front of a space run or a line feed:
    no such vocabulary string, and no normalisation that would move them."""
    sp = _model(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    probe = "a  b\nc é ﬁ Ａ \t x "
    same = sp.normalize(probe) == _BAR + probe.replace(" ", _BAR)
    return same and not any(_BAR in p.lstrip(_BAR) or "\n" in p for p in pieces)


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (without the leading space mark) that the library
    encodes alone as exactly one token."""
    sp = _model(path)
    words = [p[1:] for i in range(sp.get_piece_size())
             if (p := sp.id_to_piece(i)).startswith(_BAR) and len(p) > 1 and _BAR not in p[1:]]
    return frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a non-empty text: the word after one space (first
    word: after the added one), spaces beyond the first kept in front; or a
    line feed and what follows it."""
    text = text.replace(_BAR, " ")
    units = text.replace("\n", " \n").split(" ")
    if "" not in units and units[0][0] != "\n":
        return units
    return [u if u[0] == "\n" else u[1:] for u in _RUNS.findall(" " + text)]


class Counter:
    """Counts tokens of texts. Counts of pre-tokens are kept in two
    generations of at most ``memo`` each; what is used moves to the young one."""

    def __init__(self, path: str, memo: int = MEMO):
        if not separable(path):
            raise ValueError(f"{path}: merges may cross spaces or line feeds; count with the plain library")
        self.sp, self.whole, self.memo = _model(path), whole_tokens(path), memo
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _sizes(self, words: set[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens that are not whole tokens."""
        known = {w: n for w in words if (n := self.young.get(w) or self.old.get(w))}
        new = [w for w in words if w not in known]
        for w, ids in zip(new, self.sp.encode(new, num_threads=1)):
            known[w] = max(1, len(ids) - (w[:1] == "\n"))      # the empty word is a lone space mark
        self.young.update(known)
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {}
        return known

    def count(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) if t else [] for t in texts]
        distinct = set().union(*split)
        rest = distinct - self.whole
        size = dict.fromkeys(distinct - rest, 1) | self._sizes(rest)
        return [sum(map(size.__getitem__, units)) for units in split]


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    if path.endswith(".model"):
        if separable(path):
            return Counter(path).count
        return lambda texts: [len(ids) for ids in _model(path).encode(texts, num_threads=1)]
    from docweave.llm.token_ids import Encoder
    enc = Encoder(path)
    return lambda texts: enc.encode(pa.array(texts, pa.large_string()))[1].tolist()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows and ids give
    a row each, null ids stay null; an empty table gives no rows; other
    columns are not read. Special strings inside texts are handled as the
    library does by default; nothing is added, cut or padded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for part in row_blocks(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = np.array(_counter(path)(texts), np.int64)
                size = np.array([len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
