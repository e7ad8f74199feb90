import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import simple8b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=300), st.integers(1, 40))
def test_round_trip(ids, times):
    x = np.array(ids * times, np.uint32)
    c = simple8b.encode(x)
    assert (simple8b.decode(c) == x).all()
    assert c.word_at[-1] == len(c.words) and c.escape_at[-1] == len(c.escapes)


@pytest.mark.parametrize("high", [1, 2, 1 << 15, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, simple8b.BLOCK, simple8b.BLOCK + 1, 3 * simple8b.BLOCK - 1])
def test_sizes_and_widths(n, high):
    x = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    assert (simple8b.decode(simple8b.encode(x)) == x).all()


def test_rare_large_ids_are_escaped():
    x = np.full(10_000, 3, np.uint32)
    x[::500] = 4_000_000_000
    c = simple8b.encode(x)
    assert len(c.escapes) == 20 and (simple8b.decode(c) == x).all()
    assert len(c.words) < 10_000 / 20


def test_memory_does_not_grow_with_the_ids():
    import tracemalloc
    x = np.random.default_rng(1).integers(0, 50_000, 1_500_000).astype(np.uint32)
    tracemalloc.start()
    c = simple8b.encode(x)
    high = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert (simple8b.decode(c) == x).all()
    high = max(high, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert high < 24 << 20                                   # 60 MB and more in one piece


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 32])
def test_words_of_many_blocks_are_greedy(high):
    """Every word takes as many ids as fit, the widest choice first, in
    blocks apart; the words of all groups follow each other."""
    r = np.random.default_rng(3)
    x = (r.integers(0, high, 3 * simple8b.BLOCK + 77) >> r.integers(0, 20, 3 * simple8b.BLOCK + 77)).astype(np.uint32)
    want, at = [], [0]
    c = simple8b.encode(x)
    for b in range(4):
        mark = (1 << int(c.cap[b])) - 1
        ids = [min(int(i), mark) for i in x[b * simple8b.BLOCK:(b + 1) * simple8b.BLOCK]]
        while ids:
            for s, (n, bits) in enumerate(simple8b.SELECTORS):
                if all(i < (1 << bits) for i in ids[:n]):
                    break
            want.append(sum((i << (k * bits) for k, i in enumerate(ids[:n])), s << 60))
            ids = ids[n:]
        at.append(len(want))
    assert c.words.tolist() == want and c.word_at.tolist() == at
