import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docweave.llm import common, exact, simhash, substring
from docweave.llm.common import components

LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key_of(text):
    v = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def a_to_z(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(120)] + [(7, 7)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {n: find(n) for n in parent if n in got}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def exact_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(a_to_z(r.text), []).append(r.doc_id)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((str(i), str(keep), len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out)


def exact_rows(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_on_odd_rows(odd_docs, clashing, no_docs):
    want = exact_brute(odd_docs.collect())
    assert exact_rows(exact.exact_dedup(odd_docs, size=16)) == want
    assert exact_rows(exact.exact_dedup(clashing)) == want
    assert exact.exact_dedup(no_docs).collect() == []


def test_names_do_not_collide_when_the_hash_does(odd_docs):
    ids = exact.identities(odd_docs, size=8, locate=lambda b: F.octet_length(b).cast("long"))
    names = {(r.ident, r.row_key): (r.level, r.name) for r in ids.collect()}
    text = {(LAST if r.doc_id is None else r.doc_id, key_of(r.text)): a_to_z(r.text) for r in odd_docs.collect()}
    assert set(names) == set(text)
    assert len(set(names.values())) == len(set(text.values()))
    assert all((names[a] == names[b]) == (text[a] == text[b]) for a in names for b in names)


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def simhash_brute(fps):
    ids = list(fps)
    label = dict(zip(range(len(ids)), range(len(ids))))

    def find(n):
        while label[n] != n:
            n = label[n]
        return n
    for i in range(len(ids)):
        for j in range(i):
            if (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {ids[i]: find(i) for i in range(len(ids))}


def test_simhash_on_odd_rows(odd_docs, clashing, no_docs):
    rows = odd_docs.collect()
    keys = {(r.doc_id, key_of(r.text)): fingerprint(r.text) for r in rows}
    group = simhash_brute(keys)
    low = {}
    for (i, _), g in group.items():
        if i is not None:
            low[g] = min(low.get(g, LAST), i)
    for d in (odd_docs, clashing):
        got = simhash.near_groups(d).collect()
        assert len(got) == len(rows)
        for r in got:
            k = (r.doc_id, r.row_key)
            assert r.fp % (1 << 64) == keys[k]
            assert r.component_id == low.get(group[k])
        kept = simhash.drop_near_duplicates(d)
        assert kept.columns == d.columns
        assert sorted(group[(r.doc_id, key_of(r.text))] for r in kept.collect()) == sorted(set(group.values()))
    assert simhash.near_groups(no_docs).collect() == []
    assert simhash.drop_near_duplicates(no_docs).columns == no_docs.columns


def test_links_find_every_pair_within_three_bits(spark):
    r = np.random.default_rng(4)
    centre = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [c for c in centre] + [c ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, k, replace=False).astype(np.uint64))
                                  for c in centre for k in (1, 2, 3, 3, 4, 6)]
    fps = np.unique(np.array(near, np.uint64))
    unique = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = simhash_brute({int(x): int(x) for x in fps})
    for hot in (4096, 4):                       # 4: anchors are cut into pairs of chunks
        label = {x.node: x.label for x in components(simhash.links(unique, hot=hot)).collect()}
        groups = {}
        for x in fps:
            signed = int(np.uint64(x).view(np.int64))
            groups.setdefault(label.get(signed, signed), set()).add(int(x))
        expected = {}
        for x, g in want.items():
            expected.setdefault(g, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def substring_brute(rows, width=20):
    docs = sorted({(LAST if r.doc_id is None else r.doc_id, key_of(r.text), r.text or "") for r in rows})
    seen, out = set(), {}
    for ident, key, text in docs:
        w = WORD.findall(text)
        gone = set()
        for i in range(len(w) - width + 1):
            s = tuple(w[i:i + width])
            if s in seen:
                gone.update(range(i, i + width))
            seen.add(s)
        out[ident, key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return sorted((str(r.doc_id), *out[LAST if r.doc_id is None else r.doc_id, key_of(r.text)]) for r in rows)


def substring_rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_substring_on_odd_rows(odd_docs, clashing, no_docs):
    want = substring_brute(odd_docs.collect())
    assert substring_rows(substring.substring_dedup(odd_docs)) == want
    assert substring_rows(substring.substring_dedup(clashing)) == want
    assert substring.substring_dedup(no_docs).collect() == []


def test_substring_with_many_repeats(spark):
    r = random.Random(2)
    passages = [" ".join(r.choice("abcdef") for _ in range(60)) for _ in range(4)]
    rows = [(r.choice([None, *range(40)]), " ".join(r.choice([*passages, "x y z", "q"]) for _ in range(r.randrange(6)))) for _ in range(150)]
    rows += [(50, "Und " * 700), (51, "Und " * 100), (52, "a\tb\nc  d " * 30)] + rows[:15]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for order in (1, 3):
        assert substring_rows(substring.substring_dedup(df, order=order)) == substring_brute(df.collect())


def test_ranges_of_a_repeated_row_are_kept_once(spark):
    """Rows that repeat id and text, and null ids, have the ranges of one row."""
    passage = " ".join(f"p{k}" for k in range(90))
    one = [(1, passage + " first"), (2, "second " + passage), (None, "none " + passage)]

    def sizes(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        got = substring._ranges(df, "doc_id", "text", substring.WIDTH, substring.ORDER).collect()
        assert all(len(x.lo) == len(x.hi) == len(set(zip(x.lo, x.hi))) < 200 for x in got)
        return df, len(got), sum(len(x.lo) for x in got)
    _, docs, once = sizes(one)
    df, many_docs, many = sizes(one + one[1:] * 200)
    assert docs == many_docs == 2
    assert many <= 4 * once < substring.repeated_words(df).count()      # what a list of every copy's ranges holds
    assert substring_rows(substring.substring_dedup(df)) == substring_brute(df.collect())


def test_equal_window_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "window_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    got = substring.repeats(np.array([1, 2]), np.array([0, 0]), np.array([0, 0]), [b"a b c d", b"x a b c"], 3)
    assert [x.tolist() for x in got] == [[2], [0], [1], [4]]


def test_blocks_of_a_long_text_are_cut_in_linear_time(spark, tmp):
    """A text of 64 MB (16,000 blocks), its copy in capitals, and one that differs in its last letter."""
    import time
    took = []
    for mb in (32, 64):
        base = F.repeat(F.lit("abcdefghijklmnop"), (F.col("id") * 0 + (mb << 16)).cast("int"))
        text = F.when(F.col("id") == 1, F.upper(base)).when(F.col("id") == 2, F.concat(base, F.lit("x"))).otherwise(base)
        spark.range(3).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp}/{mb}")
        began = time.time()
        got = {r.doc_id: r for r in exact.exact_dedup(spark.read.parquet(f"{tmp}/{mb}")).collect()}
        took.append(time.time() - began)
        assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True)}
    assert took[1] < 2.5 * took[0] + 5


def test_memory_of_a_bucket():
    """Arrays by word are of one piece, and the table of powers does not grow with a bucket."""
    import tracemalloc
    r = np.random.default_rng(1)
    text = [b" ".join(b"w%05d" % j for j in x) for x in r.integers(0, 5000, (30_000, 29))]
    n, size = len(text), sum(map(len, text))
    substring.repeats(np.arange(2), np.zeros(2, np.int64), np.zeros(2, np.int64), text[:2], 20)
    tracemalloc.start()
    substring.repeats(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), text, 20)
    high = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert high < 7 * size                                   # 12 times in one piece
    h = r.integers(0, 1 << 62, 1_200_000).astype(np.uint64)
    common._POW.clear()
    assert (substring.window_hashes(h, 20)[-5:] == substring.window_hashes(h[-24:], 20)).all()
    assert len(common._powers(1)[0]) <= 2 * common.PIECE
