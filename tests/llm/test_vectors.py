import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import centroids, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def f32(rows):
    return [[float(np.float32(c)) for c in r] for r in rows]


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)


# ---------------------------------------------------------------- rank-one updates

@pytest.mark.parametrize("d,n", [(1, 4), (2, 7), (8, 60), (16, 9)])
def test_rank_one_updates_equal_an_eigendecomposition(d, n):
    rng = np.random.default_rng(d)
    x = np.floor(64 * rng.normal(size=(n, d)))
    if n == 60:
        x[:, 3], x[:, 4], x[10:30] = x[:, 2], 0, x[:20]              # equal values and weights of zero are deflated
    vals, vecs, m, mean = whitening.add_vectors(np.zeros(d), np.eye(d), 0, np.zeros(d), x)
    off = x - x.mean(axis=0)
    scatter = off.T @ off
    assert m == n and np.allclose(mean, x.mean(axis=0))
    assert np.abs(vals - np.linalg.eigvalsh(scatter)).max() <= 1e-12 * scatter.max()
    assert np.abs(vecs @ np.diag(vals) @ vecs.T - scatter).max() <= 1e-12 * scatter.max()
    assert np.abs(vecs.T @ vecs - np.eye(d)).max() <= 1e-12


def test_roots_of_the_secular_equation_interlace():
    rng = np.random.default_rng(5)
    for k in (2, 3, 40):
        d = np.sort(rng.uniform(size=k))
        d[1] = d[0] + 1e-12
        z = rng.normal(size=k) * 10.0 ** rng.integers(-6, 1, k)
        w = whitening.secular(d, z)
        root_above = -np.diagonal(w)
        assert (root_above > 0).all() and (np.diagonal(w, 1) > 0).all()
        left = 1 + (z * z / w).sum(axis=1)
        assert (np.abs(left) <= 1e-9 * (1 + np.abs(z * z / w).sum(axis=1))).all()


def test_spectra_are_combined_in_a_tree(spark):
    rng = np.random.default_rng(1)
    x = (64 * rng.normal(size=(90, 5))).astype(int) + 1_000_000
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(20)
    from docweave.llm.common import stage
    spectra = stage(df.mapInArrow(whitening._partition_spectra(5), whitening._SPECTRUM))
    assert spectra.count() > 8                                            # more than one level
    top = vectors.fold(spectra, whitening._combine(5)).first()
    off = x - x.mean(axis=0)
    assert top["n"] == 90 and [int(t) for t in top["total"]] == x.sum(axis=0).tolist() and top["node"] == 0
    assert np.allclose(top["vals"], np.linalg.eigvalsh(off.T @ off), rtol=1e-9)


# ---------------------------------------------------------------- whitening

def whiten_brute(rows, dim):
    keep = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in keep})
    n, s = len(distinct), [sum(c) for c in zip(*distinct)]
    off = np.array([[float(n * c - t) / n for c, t in zip(x, s)] for x in distinct])
    cov = off.T @ off / n
    e, u = np.linalg.eigh(cov)
    return keep, n, s, cov, e[::-1], u[:, ::-1]


def check_whitening(df, rows, dim):
    keep, n, s, cov, e, u = whiten_brute(rows, dim)
    got = df.collect()
    use = min(16, dim)
    assert len(got) == use * len(keep)
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c + 1) for i, _ in keep for c in range(use))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for i, x in keep:
        assert {r.deviation for r in by[i][1]} >= {sum((n * c - t) ** 2 for c, t in zip(x, s))}
    first = {i: x for i, x in reversed(keep)}
    ids = [i for i in first if len(by[i][1]) == 1]
    off = np.array([[float(n * c - t) / n for c, t in zip(first[i], s)] for i in ids])
    for c in range(use):
        assert all(r.n == n for rs in by.values() for r in rs[c + 1])
        r = by[ids[0]][c + 1][0]
        assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-8)
        assert r.identity_error <= 1e-8
        mine = np.array([by[i][c + 1][0].whitened for i in ids])
        want = off @ u[:, c] / math.sqrt(e[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    scale = np.linspace(0.05, 1.0, 20)
    rows = [(i, v) for i, v in enumerate(f32(rng.normal(size=(300, 20)) * scale))]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, [None] + [0.0] * 19), (1004, [NAN] + [0.0] * 19),
             (1005, [INF] + [0.0] * 19), (1006, []), (1007, [1.0])]
    check_whitening(whitening.whiten(table(spark, rows, 11)), rows, 20)


def test_whitening_fits_every_distinct_vector_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(f32(rng.normal(size=(60, 3))))]
    hot = [(1000 + i, rows[0][1]) for i in range(60)]                    # half of all rows are one vector
    a = whitening.whiten(table(spark, rows)).filter("component = 1").first()
    b = whitening.whiten(table(spark, rows + hot)).filter("component = 1").first()
    assert a.n == b.n == 60 and a.explained == pytest.approx(b.explained, rel=1e-12)


def test_whitening_without_variance_or_rows(spark):
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(table(spark, [(None, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [4.0, 4.0])])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert {round(r.explained, 12) for r in line if r.component == 1} == {1.0} and {r.vec_id for r in line} == {None, 2, 3}
    for rows in ([], [(1, None)], [(1, []), (2, [NAN])]):
        df = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.collect() == []


def test_whitening_reads_no_other_columns(spark):
    df = table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [0.0, 1.0])])
    extra = df.select("*", *[F.lit(1).alias(c) for c in ("x", "n", "node", "vals", "component", "whitened", "deviation", "vec")])
    assert sorted(map(str, whitening.whiten(extra).select("component", "deviation", "explained").collect())) == sorted(
        map(str, whitening.whiten(df).select("component", "deviation", "explained").collect()))


def test_deviation_is_exact_or_null():
    big = whitening.Centre(3, [3 << 40, 6, 1])
    x = np.array([[(1 << 40) + 5, 2, 0], [1 << 50, 0, 0], [(1 << 40) + (1 << 29), 2, 0]], np.int64)
    want = [sum((3 * int(c) - t) ** 2 for c, t in zip(r, [3 << 40, 6, 1])) for r in x]
    assert big.deviation(x).to_pylist() == [w if w < 1 << 63 else None for w in want] and want[1] >= 1 << 63 > want[2]


# ---------------------------------------------------------------- centroid clustering

def lloyd(rows, dim, k, rounds):
    keep = [(i, [math.floor(64 * c) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cent = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        groups = {}
        for _, x in keep:
            groups.setdefault(nearest(x)[1], []).append(x)
        cent = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c0 for j, c0 in enumerate(cent)]
    out = [(i, *reversed(nearest(x))) for i, x in keep]
    by = {}
    for _, j, d in out:
        by[j] = by.get(j, 0) + d
    return sorted((str(i), j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for i, j, d in out)


def clustered(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,spread,rounds", [(1, 1.0, 3), (2, 0.02, 6), (3, 0.0, 2)])
def test_centroids_equal_lloyd(spark, seed, spread, rounds):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 4))
    rows = [(i, v) for i, v in enumerate(f32(middle[rng.integers(0, 9, 400)] + spread * rng.normal(size=(400, 4))))]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (900, None), (901, [1.0]), (902, [NAN, 0.0, 0.0, 0.0]), (903, [None, 0.0, 0.0, 0.0]),
             (904, []), (905, [INF, 0.0, 0.0, 0.0])]
    got = clustered(centroids.centroid_clusters(table(spark, rows), dim=4, k=7, rounds=rounds))
    assert got == lloyd(rows, 4, 7, rounds)


def test_bounds_skip_distances_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    middle = 20 * rng.normal(size=(4, 6))
    rows = [(i, v) for i, v in enumerate(f32(middle[rng.integers(0, 4, 600)] + 0.1 * rng.normal(size=(600, 6))))]
    df = centroids.centroid_clusters(table(spark, rows), dim=6, k=4, rounds=5)
    assert clustered(df) == lloyd(rows, 6, 4, 5)
    assert df.agg(F.avg("scans")).first()[0] < 4                          # of six rounds


def test_displacement_is_whole_not_summed():
    there, back = np.array([[0], [1000]]), np.array([[40], [1000]])
    a = centroids.Assigner([there, back, there], last=False)
    assert a.moved[0, 0] == 0 and a.moved[1, 0] == pytest.approx(40)
    x = np.array([[10]])
    state = [np.zeros(1, np.int32), np.array([10.0]), np.zeros(1, np.int32), np.array([990.0]), np.zeros(1, np.int32), np.ones(1, np.int32)]
    cluster, distance, own, own_round, low, low_round, scans = a(x, *state)
    assert scans[0] == 1 and own_round[0] == 0 and distance[0] is None     # untouched although the drifts sum to 80


def test_distances_are_exact_at_any_size():
    for big in (5, 1 << 22, 1 << 29, 1 << 50):
        x = np.array([[big, -big, 3], [0, 1, 2]], np.int64)
        c = np.array([[-big, big, 4], [big, 0, 0]], np.int64)
        got = centroids.squared_distances(x, c)
        assert [[int(v) for v in r] for r in got] == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]


def test_huge_small_and_no_vectors(spark):
    big = [(1, [3.0e9, 0.0]), (2, [-3.0e9, 1.0]), (3, [1.0e14, 0.0])]
    rows = centroids.centroid_clusters(table(spark, big), dim=2, k=2, rounds=1).collect()
    assert len(rows) == 3 and all(r.inertia is None for r in rows)
    assert clustered(centroids.centroid_clusters(table(spark, [(5, [1.0, 2.0])] * 3), dim=2)) == lloyd([(5, [1.0, 2.0])] * 3, 2, 16, 3)
    for rows in ([], [(1, None)], [(1, [1.0])]):
        df = centroids.centroid_clusters(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
        assert df.collect() == [] and "centroid_sha256" in df.columns


def test_centroids_read_no_other_columns(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(40)]
    extra = table(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("x", "sums", "cluster", "own", "low", "distance", "scans", "vec")])
    assert clustered(centroids.centroid_clusters(extra, dim=2, k=3)) == lloyd(rows, 2, 3, 3)


def test_lists_and_matrix_round_trip():
    m = np.arange(12).reshape(4, 3)
    assert (vectors.matrix(vectors.lists(m), 3) == m).all()
    assert vectors.matrix(pa.array([[1, 2], [3, 4], [5, 6]]).slice(1), 2).tolist() == [[3, 4], [5, 6]]
