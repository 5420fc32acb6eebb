"""Ranks, clusters, eigenvectors, singular vectors and correlations against plain NumPy."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import clusters, coresponse, factor, ranks


def test_ranks_against_counting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", None, "b"]), rng.choice([None, 1.0, 2.0, 2.0, rng.random(), -0.0, 0.0])) for i in range(300)]
    got = {r.id: r for r in ranks.ranked(spark.createDataFrame(rows, "id int, k string, v double").repartition(6), "v", "k").collect()}
    for i, k, v in rows:
        same = [x for _, kk, x in rows if kk == k and x is not None]
        want = (None, None, len(same)) if v is None else (sum(x < v for x in same) + 1, sum(x <= v for x in same), len(same))
        assert (got[i].rank_low, got[i].rank_high, got[i].rank_of) == want
    assert ranks.ranked(spark.createDataFrame([], "id int, k string, v double"), "v", "k").count() == 0


def test_rank_transform(spark):
    shares = [1e-7, 1e-5, 0.01, 0.0749, 0.075, 0.0751, 0.3, 0.5, 0.9, 0.925, 1 - 1e-7]
    for r in spark.createDataFrame([(x,) for x in shares], "p double").withColumn("z", F.expr(ranks.inverse_normal_sql("p"))).collect():
        assert abs(r.z - statistics.NormalDist().inv_cdf(r.p)) < 1e-12
    got = {r.id: r.z for r in ranks.rank_transform(spark.createDataFrame([(1, 5.0, None), (2, 7.0, None), (3, 5.0, None), (4, None, 1.0)], "id int, a double, b double"), "id", ["a", "b"]).collect()}
    z = lambda p: statistics.NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) / 2**0.5
    assert np.allclose([got[i] for i in (1, 2, 3, 4)], [[z(0.25), 0], [z(1), 0], [z(0.25), 0], [0, 0]])


def _plain_ward(points, k):
    groups = [[i] for i in range(len(points))]
    while len(groups) > k:
        pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]

        def cost(p):
            a, b = groups[p[0]], groups[p[1]]
            return len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum()

        i, j = min(pairs, key=cost)
        groups[i] += groups[j]
        del groups[j]
    return sorted(map(sorted, groups))


def test_ward_against_plain_agglomeration():
    rng = np.random.default_rng(0)
    for _ in range(10):
        points = rng.normal(size=(25, 3))
        merges = clusters.ward(points)
        for k in (1, 2, 5, 9, 25):
            labels = clusters.cut(merges, 25, k)
            assert sorted(np.flatnonzero(labels == c).tolist() for c in range(k)) == _plain_ward(points, k)


def _plain_merge(z, labels, least):
    labels = labels.copy()
    while len(present := np.unique(labels)) > 1:
        sizes = {c: (labels == c).sum() for c in present}
        victim = min(present, key=lambda c: (sizes[c], c))
        if sizes[victim] >= least:
            break
        here = z[labels == victim].mean(0)
        labels[labels == victim] = min((c for c in present if c != victim), key=lambda c: (((z[labels == c].mean(0) - here) ** 2).sum(), c))
    return np.unique(labels, return_inverse=True)[1]


def test_clusters_against_plain(spark):
    rng = np.random.default_rng(4)
    z, mean = np.concatenate([rng.normal(c, 0.4, (n, 2)) for c, n in ((0, 40), (3, 25), (6, 3), (9, 2), (12, 30), (15, 5), (18, 20))]), rng.normal(size=125)
    labels = np.repeat(np.arange(7), [40, 25, 3, 2, 30, 5, 20])
    table = spark.createDataFrame([(i, z[i].tolist(), int(labels[i]), float(mean[i])) for i in range(125)], "feature int, z array<double>, label int, m double")
    want = _plain_merge(z, labels, 10)
    names, sizes, centroids, _ = clusters.sums(table)
    assert (clusters.merge_small(sizes, centroids, 10)[np.searchsorted(names, labels)] == want).all()
    assert (clusters.merge_small(sizes, centroids, 1000) == 0).all()
    got = {r.feature: r for r in clusters.nested(table, "feature", "m", (2, 3, 8), 10).collect()}
    centre = np.stack([z[want == c].mean(0) for c in range(want.max() + 1)])
    for level in (2, 3, 8):
        mine = np.array([got[i][f"k{level}"] for i in range(125)])
        groups = _plain_ward(centre, min(level, len(centre)))
        plain = np.array([next(g for g, members in enumerate(groups) if c in members) for c in want])
        assert len(set(zip(mine, plain, strict=True))) == len(groups) == mine.max() + 1
        assert (np.diff([mean[mine == c].mean() for c in range(len(groups))]) > 0).all()
    assert len({(got[i].k8, got[i].k2) for i in range(125)}) == want.max() + 1


def test_fine_clusters(spark):
    z = np.random.default_rng(2).normal(size=(60, 2)) + np.repeat([[0, 0], [20, 0], [0, 20]], 20, axis=0)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "feature int, z array<double>")
    labels = np.array([r.label for r in clusters.fine_clusters(table, "feature", 3).orderBy("feature").collect()])
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 20])) == 1 for i in (0, 20, 40))
    assert {r.label for r in clusters.fine_clusters(table, "feature", 1).collect()} == {0}


def test_graph_eigenvectors_against_dense(spark):
    rng = np.random.default_rng(3)
    w = np.triu(rng.random((60, 60)) * (rng.random((60, 60)) < 0.15), 1)
    for c in range(3):
        w[c * 20 : c * 20 + 20, c * 20 : c * 20 + 20] += np.triu(rng.random((20, 20)), 1)
    w += w.T
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(60) for j in range(i + 1, 60) if w[i, j] > 0], "src long, dst long, weight double")
    out, values, residual = factor.graph_eigenvectors(edges, 2, max_rounds=8)
    got = {r.node: r for r in out.collect()}
    d = w.sum(1)
    want, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    want, vectors = want[::-1][1:3], vectors[:, ::-1][:, 1:3]
    assert np.allclose(values, want, atol=1e-8) and residual < 1e-3
    assert np.allclose([got[i].degree for i in range(60)], d)
    y = np.array([got[i].y for i in range(60)])
    assert np.allclose(np.linalg.svd(vectors.T @ y, compute_uv=False), 1, atol=1e-7)
    assert np.allclose(y.T @ y, np.eye(2), atol=1e-9) and all(y[np.abs(y[:, j]).argmax(), j] > 0 for j in range(2))


def test_truncated_svd_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 25)) * (rng.random((40, 25)) < 0.5)
    fit = np.arange(40) % 3 != 0
    entries = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(40) for j in range(25) if x[i, j]], "entity long, feature string, value double")
    entities = spark.createDataFrame([(i, bool(fit[i])) for i in range(40)] + [(99, True)], "entity long, fit boolean")  # 99 has no entry
    for centre in (False, True):
        scores, loadings, values, squares = factor.truncated_svd(entries, entities, 3, centre=centre)
        m = np.vstack([x[fit], np.zeros(25)])
        mean = m.mean(0) * centre
        _, s, vt = np.linalg.svd(m - mean)
        assert np.allclose(values, s[:3], rtol=1e-6) and abs(squares - (s**2).sum()) < 1e-8
        got = {r.entity: r.score for r in scores.collect()}
        mine, want = np.array([got[i] for i in [*range(40), 99]]), (np.vstack([x, np.zeros(25)]) - mean) @ vt[:3].T
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-4)
        assert abs(np.linalg.norm([r.loading for r in loadings.collect()], axis=0) - 1).max() < 1e-9


def test_bits_have_the_components_of_the_dense_matrix(spark):
    """What fe_entity_pca does: centred components of sets, never a dense matrix of bits."""
    rng = np.random.default_rng(6)
    x = (rng.random((50, 30)) < np.where(np.arange(50)[:, None] < 25, 0.2, 0.5) * np.linspace(0.3, 1.6, 30)).astype(float)
    entries = spark.createDataFrame([(i, j, 1.0) for i in range(50) for j in range(30) if x[i, j]], "entity int, feature int, value double")
    scores, _, values, squares = factor.truncated_svd(entries, spark.createDataFrame([(i, i % 5 != 0) for i in range(50)], "entity int, fit boolean"), 2, centre=True)
    m = x[np.arange(50) % 5 != 0]
    _, s, vt = np.linalg.svd(m - m.mean(0))
    got = {r.entity: r.score for r in scores.collect()}
    assert np.allclose(np.array(values) ** 2 / squares, (s**2 / (s**2).sum())[:2], rtol=1e-6)
    assert np.allclose(np.abs([got[i] for i in range(50)]), np.abs((x - m.mean(0)) @ vt[:2].T), atol=1e-3)


def test_principal_angles_against_numpy(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(70, 3)), rng.normal(size=(70, 3))
    b[:, 0] = a[:, 1] * 2 + 5
    table = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "sample int, s array<double>")
    cosines, correlations = factor.principal_angles(table(a), table(b), "sample", "s", 3)
    qa, qb = (np.linalg.qr(m - m.mean(0))[0] for m in (a, b))
    assert np.allclose(cosines, np.linalg.svd(qa.T @ qb, compute_uv=False), atol=1e-6)
    assert np.allclose(correlations, np.abs(np.corrcoef(a.T, b.T)[:3, 3:]))
    assert np.degrees(np.arccos(factor.principal_angles(table(a), table(a), "sample", "s", 3)[0])).max() < 1e-4


def test_coresponse_in_blocks_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 23)) + rng.normal(size=(90, 23))
    x[rng.random((90, 23)) < 0.3] = np.nan
    x[15:, 5] = np.nan  # too few values
    cells = spark.createDataFrame([(f"s{i}", f"f{j:02d}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(90) for j in range(23)], "sample_id string, feature_id string, value double")
    z = np.nan_to_num((x - np.nanmean(x, 0)) / np.nanstd(x, 0))
    z[:, 5] = 0
    w = z.T @ z / 89
    np.fill_diagonal(w, -np.inf)
    want = {}
    for i in range(23):
        for j in sorted((j for j in range(23) if j not in (i, 5)), key=lambda j: (-w[i, j], j))[:4]:
            if i != 5 and w[i, j] > 0:
                want[min(i, j), max(i, j)] = w[i, j]
    for block, rows, deals in ((5, 16, 3), (256, 1024, 8)):
        got = {(int(r.src[1:]), int(r.dst[1:])): r for r in coresponse.coresponse_knn(cells, k=4, block=block, rows=rows, deals=deals).collect()}
        assert set(got) == set(want) and all(abs(got[e].weight - want[e]) < 1e-9 for e in want)
        assert all(got[i, j].n == (~np.isnan(x[:, i]) & ~np.isnan(x[:, j])).sum() for i, j in want)
