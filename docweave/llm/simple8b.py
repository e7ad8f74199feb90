"""Simple-8b word-aligned coding of token ids, vectorised.

A 64-bit word is a selector (high 4 bits) and 60 bits of payload that hold a
fixed count of fixed-width ids, the first in the lowest bits. Ids are coded in
blocks of ``BLOCK``; each block starts at a word of its own (its offset is
stored), so blocks can be decoded apart or all at once. In each block ids of
``cap`` bits or more are escaped: the field holds the all-ones mark of width
``cap`` and the id itself follows in the block's escape list, so one large id
does not widen its neighbours' fields. ``cap`` is chosen per block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Selector -> (ids in the word, bits of each id).
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
             (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([n for n, _ in SELECTORS])
_STEP = COUNT.astype(np.uint8)
BLOCK = 2048
#: Field widths that a block may stop at; the smallest at which no more than
#: one id in ``ESCAPES`` is escaped is taken. The last one fits every id.
CAPS = (20, 32)
ESCAPES = 16
_PAD = 240
#: Blocks coded at a time: scratch arrays do not grow with the ids.
GROUP = 64


@dataclass
class Coded:
    words: np.ndarray            # uint64, blocks one after the other
    word_at: np.ndarray          # int32, first word of each block, and the end
    cap: np.ndarray              # uint8 per block
    escapes: np.ndarray          # uint32
    escape_at: np.ndarray        # int32, first escape of each block, and the end
    n: int


_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)     # 0 for 0, else bit length


def _width(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint32(16)
    width = _BITS[x & np.uint32(0xFFFF)]
    return np.where(high > 0, _BITS[high] + np.uint8(16), width) if high.any() else width


def _plan(fields: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy words of each row of ``fields`` (ids padded with zeros):
    block number, position in the whole table and selector of each word, in order."""
    width = _width(fields)
    cols = fields.shape[1]
    top = {1: width}
    for n in (2, 4, 8, 16, 32, 64, 128):
        h = top[n // 2]
        m = h.copy()
        np.maximum(h[:, : cols - n // 2], h[:, n // 2:], out=m[:, : cols - n // 2])
        top[n] = m
    choice = np.full(fields.shape, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        n, bits = SELECTORS[s]
        p = 1 << (n.bit_length() - 1)
        m = top[p]
        if n > p:
            m = m.copy()
            np.maximum(m[:, : cols - (n - p)], top[p][:, n - p:], out=m[:, : cols - (n - p)])
        np.minimum(choice, ((m > bits).view(np.uint8) << 4) + np.uint8(s), out=choice)      # 16 and over: does not fit
    # All rows step from word to word together; a row that is through stays where it is.
    inside = np.arange(cols) < length[:, None]
    step = (_STEP[choice] * inside).reshape(-1)
    at = np.arange(len(fields)) * cols
    first = np.zeros(fields.size, bool)
    while True:
        path = []
        for _ in range(64):
            path.append(at)
            at = at + step.take(at)
        first[np.concatenate(path)] = True
        if not step.take(at).any():
            break
    pos = np.flatnonzero(first & inside.reshape(-1))
    return pos // cols, pos, choice.reshape(-1)[pos]


def _ends(parts: list[np.ndarray]) -> np.ndarray:
    """Offsets of groups as offsets of the whole."""
    out, base = [np.zeros(1, np.int64)], 0
    for x in parts:
        out.append(x[1:].astype(np.int64) + base)
        base += int(x[-1])
    return np.concatenate(out).astype(np.int32)


def encode(ids: np.ndarray, caps: tuple[int, ...] = CAPS) -> Coded:
    ids = np.asarray(ids, np.uint32)
    if len(ids) <= GROUP * BLOCK:
        return _encode(ids, caps)
    parts = [_encode(ids[i:i + GROUP * BLOCK], caps) for i in range(0, len(ids), GROUP * BLOCK)]
    whole = lambda k: np.concatenate([getattr(c, k) for c in parts])
    return Coded(whole("words"), _ends([c.word_at for c in parts]), whole("cap"), whole("escapes"),
                 _ends([c.escape_at for c in parts]), len(ids))


def _encode(ids: np.ndarray, caps: tuple[int, ...]) -> Coded:
    n = len(ids)
    blocks = -(-n // BLOCK)
    table = np.zeros((blocks, BLOCK + _PAD), np.uint32)
    flat = np.zeros(blocks * BLOCK, np.uint32)
    flat[:n] = ids
    table[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = n - (blocks - 1) * BLOCK
    cap = np.full(blocks, caps[-1], np.uint8)
    for c in caps[-2::-1]:
        cap[(table >= np.uint32((1 << c) - 1)).sum(axis=1) * ESCAPES <= BLOCK] = c
    mark = ((np.uint64(1) << cap.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    escaped = table >= mark[:, None]
    fields = np.minimum(table, mark[:, None])
    block, pos, sel = _plan(fields, length)
    words = sel.astype(np.uint64) << np.uint64(60)
    flat = fields.reshape(-1)
    for s, (k, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if bits and len(own):
            start, word = pos[own], words[own]
            for i in range(k):
                word |= flat[start + i].astype(np.uint64) << np.uint64(i * bits)
            words[own] = word
    at = np.concatenate(([0], np.cumsum(np.bincount(block, minlength=blocks))))
    esc_at = np.concatenate(([0], np.cumsum(escaped.sum(axis=1))))
    return Coded(words, at.astype(np.int32), cap, table[escaped], esc_at.astype(np.int32), n)


def decode(c: Coded) -> np.ndarray:
    """All ids, a group of blocks at a time."""
    out = np.empty(c.n, np.uint32)
    for i in range(0, len(c.cap), GROUP):
        j = min(i + GROUP, len(c.cap))
        n = min(j * BLOCK, c.n) - i * BLOCK
        w, e = c.word_at[[i, j]], c.escape_at[[i, j]]
        out[i * BLOCK: i * BLOCK + n] = _decode(Coded(c.words[w[0]:w[1]], c.word_at[i:j + 1] - w[0], c.cap[i:j],
                                                      c.escapes[e[0]:e[1]], c.escape_at[i:j + 1] - e[0], n))
    return out


def _decode(c: Coded) -> np.ndarray:
    blocks = len(c.cap)
    sel = (c.words >> np.uint64(60)).astype(np.int64)
    count = COUNT[sel]
    start = np.concatenate(([0], np.cumsum(count)))
    values = np.zeros(start[-1], np.uint64)
    for s, (k, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == s)
        if bits and len(own):
            vals = c.words[own][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(bits))
            values[start[own][:, None] + np.arange(k)] = vals & np.uint64((1 << bits) - 1)
    length = np.full(blocks, BLOCK)
    length[-1] = c.n - (blocks - 1) * BLOCK
    first = start[c.word_at[:-1]]
    index = np.arange(c.n) - np.repeat(np.arange(blocks) * BLOCK, length) + np.repeat(first, length)
    out = values[index].astype(np.uint32)
    mark = ((np.uint64(1) << c.cap.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    out[out == np.repeat(mark, length)] = c.escapes
    return out
