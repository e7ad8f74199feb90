import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import prefix_join as pj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, part=90, whole=100):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and whole * len(a & b) >= part * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = [v for v in (least.get(find(k)), i) if v is not None]
        least[find(k)] = min(known) if known else None
    return sorted((str(i), len(sets[k]), str(least[find(k)])) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def families(seed, n_families, copies, words, edits):
    """Copies with a few words changed, dropped or added, and a passage that all hold."""
    r = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(12))
    rows = []
    for f in range(n_families):
        base = [f"w{r.randrange(4000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                i = r.randrange(len(w))
                kind = r.randrange(3)
                w[i:i + 1] = [] if kind == 0 else [f"w{r.randrange(4000)}"] if kind == 1 else [w[i], f"n{r.randrange(4000)}"]
            rows.append((len(rows) + 1, " ".join(w) + (" " + common if r.random() < 0.7 else "")))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n_families,copies,words,edits", [(1, 12, 8, 120, 6), (2, 3, 40, 60, 3), (3, 40, 3, 30, 2)])
def test_classes_equal_brute_force(spark, seed, n_families, copies, words, edits):
    rows = families(seed, n_families, copies, words, edits)
    want = brute(rows)
    assert got(pj.jaccard_classes(frame(spark, rows))) == want
    assert 1 < len({c for _, _, c in want}) < len(rows)


def test_long_lists_are_cut(spark):
    rows = families(5, 2, 50, 50, 4)
    assert got(pj.jaccard_classes(frame(spark, rows), hot=8)) == brute(rows)


def test_other_threshold(spark):
    rows = families(6, 6, 10, 40, 6)
    assert got(pj.jaccard_classes(frame(spark, rows), part=6, whole=10)) == brute(rows, 6, 10)


def test_exactly_at_the_threshold(spark):
    base = [f"a{i}" for i in range(21)]                        # 19 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[:-2])), (4, " ".join(base[1:-2])), (9, " ".join(base[:-3] + ["x", "y", "z"]))]
    assert got(pj.jaccard_classes(frame(spark, rows))) == brute(rows)


def test_odd_documents(odd_docs, clashing):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(rows)
    assert got(pj.jaccard_classes(odd_docs)) == want
    assert got(pj.jaccard_classes(clashing.withColumns({c: F.lit("z") for c in ("uid", "gid", "token", "n", "comp", "rep", "least", "m", "k")}))) == want


def test_no_documents(no_docs, spark):
    assert pj.jaccard_classes(no_docs).collect() == []
    assert got(pj.jaccard_classes(frame(spark, [(1, None), (2, ""), (2, ""), (3, " \n")]))) == [(str(i), 0, str(i)) for i in (1, 2, 2, 3)]


def test_a_third_of_the_rows_repeat(spark):
    rows = families(7, 4, 10, 50, 3)
    rows += [rows[0]] * 20 + [(None, rows[0][1])]
    assert got(pj.jaccard_classes(frame(spark, rows))) == brute(rows)


def test_a_large_family_needs_few_pairs(spark, monkeypatch):
    rows = families(8, 1, 300, 150, 2)
    checked = []
    call = pj._Verifier.__call__
    monkeypatch.setattr(pj._Verifier, "__call__", lambda self, pairs: (checked.append(pairs.count()), call(self, pairs))[1])
    assert got(pj.jaccard_classes(frame(spark, rows))) == brute(rows)
    assert sum(checked) < len(rows) ** 2 / 20                      # a tenth of all pairs


def test_sets_are_those_of_the_words():
    texts = ["", "One", "one TWO", "a b c d a b c", "Ä b\x0bc\x00 d", "a b c\n a b c"]
    h, cut = pj.shingle_sets([t.encode() for t in texts], 3)
    assert np.diff(cut).tolist() == [len(shingles(t)) for t in texts]
    both = pj.shingle_sets([b"x a b c", b"a b c y", b"a B c"], 3)
    runs = [set(both[0][a:b].tolist()) for a, b in zip(both[1][:-1], both[1][1:])]
    assert len(runs[0] & runs[1]) == 1 and runs[2] < runs[0]


def test_prefix_length():
    for n in range(1, 300):
        p = pj.prefix_length(n)
        assert 1 <= p <= n and p == n - -(-n * 9 // 10) + 1


def test_levels_count_all_documents(spark):
    rows = [(i, "the same three words") for i in range(40)] + [(99, "other words here")]
    levels = pj.shingle_levels(frame(spark, rows))
    h, _ = pj.shingle_sets([b"the same three words", b"other words here"], 3)
    assert levels[(h >> np.uint64(64 - pj.BUCKET_BITS)).astype(int)].tolist() == [6, 6, 1]
