import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash

from docweave.llm import quality
from docweave.llm.common import LOWER, gram_hashes, span_hashes

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")


def chained(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    """Hashes of the tokens and of neighbouring pairs, one by one."""
    h = []
    for t in TOKEN.findall((text or "").encode()):
        b = np.frombuffer(t, np.uint8)
        h.append(int(span_hashes(b, np.array([0]), np.array([len(b)]), LOWER)[0]))
    return h + [int(gram_hashes(np.array(p, np.uint64), 2)[0]) for p in zip(h, h[1:])]


def by_hand(docs, labels):
    """Weight, key and verdict of every row, with dictionaries and loops; ids and texts are distinct."""
    half = {i: signed(chained(i, "half")) % 2 for i in labels}
    text = dict(docs)
    target, raw = {}, {}
    for i, t in docs:
        for g in grams(t):
            b = g & (quality.BUCKETS - 1)
            raw[b] = raw.get(b, 0) + 1
            if i in labels and labels[i] == (1, 0) and half[i] == 0:
                target[b] = target.get(b, 0) + 1
    n_target, n_raw = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    ratio = {b: math.log((target.get(b, 0) + 1) / n_target) - math.log((raw.get(b, 0) + 1) / n_raw) for b in raw}
    toxic, other = [i for i in labels if labels[i][1]], [i for i in labels if not labels[i][1]]
    share = len(toxic) / len(labels)
    holders = {}
    for i in labels:
        for g in set(grams(text[i])):
            holders.setdefault(g, [0, 0])[labels[i][1]] += 1
    harm = {}
    for g, (b, a) in holders.items():
        odds = -a * math.log(share) - math.log(math.comb(a + b, a))
        if a >= 0.9 * (a + b) and a > 0 and odds >= math.log(1e7):
            harm[g] = math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(other) + 1))
    least_harm = math.log(100) - math.log(len(toxic) / len(other))
    weight, key = {}, {}
    for i, t in docs:
        g = grams(t)
        h = sum(harm.get(x, 0.0) for x in g)
        weight[i] = 256 * sum(ratio[x & (quality.BUCKETS - 1)] for x in g) / max(1, len(g)) - (256 * h if h >= least_harm and harm else 0)
        row = signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
        u = ((chained(i, row, "gumbel") >> 11) + 0.5) / (1 << 53)
        key[i] = weight[i] - math.log(-math.log(u))
    clean = [weight[i] for i in labels if labels[i] == (1, 0) and half[i] == 1]
    bad = [weight[i] for i in labels if labels[i][0] == 0 and half[i] == 1]
    v = sorted(set(clean + bad))
    cuts = [v[0] - 1] + [(a + b) / 2 for a, b in zip(v, v[1:])] + [v[-1] + 1]
    cut = max(cuts, key=lambda c: 10 * sum(w >= c for w in clean) / len(clean) + sum(w < c for w in bad) / len(bad))
    k = sum(w >= cut for w in weight.values())
    kept = set(sorted(key, key=lambda i: -key[i])[:k])
    return weight, key, kept, harm


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_harm_and_kept_set_equal_brute_force(spark, seed):
    r = random.Random(seed)
    good, junk = [f"good{i}" for i in range(300)], [f"junk{i}" for i in range(300)]
    docs, labels = [], {}
    for i in range(400):
        kind = r.choice(["clean", "clean", "low", "toxic"] if i % 2 else ["clean", "low"])
        words = r.choices(good if kind != "low" else junk, k=r.randrange(20, 80)) + r.choices(good + junk, k=10)
        if kind == "toxic":
            words += [f"vile{r.randrange(3)}", "vile!"]
        r.shuffle(words)
        docs.append((i, " ".join(words) + f" #{i}."))
        if i < 300:
            labels[i] = (0 if kind == "low" else 1, int(kind == "toxic"))
    docs += [(900, None), (901, "É" + " mixed,CASE words")]
    weight, key, kept, harm = by_hand(docs, labels)
    assert harm and 0 < len(kept) < len(docs)
    got = quality.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                           spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    for x in got:
        assert x.log_weight == pytest.approx(weight[x.doc_id], rel=1e-5, abs=1e-4)
        assert x.sample_key == pytest.approx(key[x.doc_id], rel=1e-5, abs=1e-4)
    assert {x.doc_id for x in got if x.keep} == kept
