"""Components, out-of-fold means, matching and imputation on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assaylake.functions.components import connected_components
from assaylake.operators import ensemble, features, graph, helpers, matching, normalize


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_out_of_fold_mean_is_a_refit(spark):
    rng = random.Random(1)
    samples = spark.createDataFrame([(str(i), str(i % 3)) for i in range(30)], "sample_id string, strain string")
    cells = [(str(i), f"f{j}", rng.random()) for i in range(30) for j in range(4) if rng.random() < 0.7]
    folds = {str(i): i % 5 for i in range(25)}
    fold_df = spark.createDataFrame(list(folds.items()), "sample_id string, fold int")
    got = features.oof_group_mean(spark.createDataFrame(cells, "sample_id string, feature_id string, value double"), samples, fold_df, ["strain"]).collect()
    for r in got:
        own = folds.get(r.sample_id)
        fit = [v for s, f, v in cells if f == r.feature_id and int(s) % 3 == int(r.sample_id) % 3 and s in folds and folds[s] != own]
        assert (r.oof is None) == (len(fit) < 3)
        assert r.oof is None or math.isclose(r.oof, sum(fit) / len(fit))


def test_control_match_takes_the_finest_level(spark):
    cols = "sample_id string, batch string, strain string, medium string, temperature string, pert_time string"
    pool = spark.createDataFrame([("c1", "b", "s", "m", "30", "15"), ("c2", "x", "s", "m", "30", "60")], cols)
    treated = spark.createDataFrame([("t1", "b", "s", "m", "30", "15"), ("t2", "b", "s", "m", "30", "60"), ("t3", "z", "q", "m", "30", "15")], cols)
    assert {r.sample_id: r.level for r in matching.match(treated, pool).collect()} == {"t1": 1, "t2": 2, "t3": 6}


def test_log2_drops_what_is_not_positive_or_finite(spark):
    x = spark.createDataFrame([(1, 8.0), (2, 0.0), (3, -1.0), (4, float("nan")), (5, float("inf")), (6, None)], "i int, value double")
    assert [r.value for r in normalize.log2(x).orderBy("i").collect()] == [3.0, None, None, None, None, None]


def test_gram_scores_equal_direct_scores(spark):
    rng = random.Random(2)
    rows = [(float(rng.random()), float(rng.random()), float(rng.random())) for _ in range(50)]
    g = ensemble.gram(spark.createDataFrame(rows, "t double, a double, b double"), ["a", "b"])
    got = ensemble.gram_pcc(g, ["a", "b"], {"a": 0.3, "b": 1.2}).first().pcc
    t, p = [r[0] for r in rows], [0.3 * r[1] + 1.2 * r[2] for r in rows]
    mt, mp = sum(t) / 50, sum(p) / 50
    want = sum((x - mt) * (y - mp) for x, y in zip(t, p, strict=True)) / math.sqrt(sum((x - mt) ** 2 for x in t) * sum((y - mp) ** 2 for y in p))
    assert math.isclose(got, want, abs_tol=1e-9)


def test_graph_components_match_union_find_and_keep_isolated_nodes(spark):
    rng = random.Random(5)
    pairs = {(f"s{rng.randrange(60)}", f"p{rng.randrange(90)}") for _ in range(70)}
    nodes = sorted({n for e in pairs for n in e} | {"s98", "s99"})
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    edges = graph.build_edges(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double"))
    got = {r.node: r.component for r in graph.components(edges, spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert got == {n: root(n) for n in nodes}


def test_components_of_numbered_nodes_have_the_names_of_named_ones(spark):
    rng = random.Random(11)
    pairs = sorted({(2 * rng.randrange(70) + 1, 2 * rng.randrange(120)) for _ in range(90)})
    nodes = [(n,) for n in sorted({n for e in pairs for n in e} | {2001})] + [(None,)]
    name = lambda c: F.concat(F.when(c.bitwiseAND(F.lit(1)) == 1, "s").otherwise("p"), F.shiftright(c, 1))
    edges, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(nodes, "node long")
    named = graph.components(edges.select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst")), nodes.select(name(F.col("node")).alias("node")))
    want = sorted(named.collect(), key=str)
    for few in (0, 1000):
        assert sorted(graph.named_components(edges, nodes, name, few).collect(), key=str) == want


def test_tanimoto_is_exact_at_every_similarity(spark):
    rng = random.Random(8)
    sets = {i: {f"b{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(1, 60))} for i in range(80)}
    sets |= {90 + i: set(sets[i]) | {f"own{i}"} for i in range(10)} | {200: {"alone"}, 201: {"b1"}}
    fit = [i for i in sets if i % 5]
    want = {}
    for i, a in sets.items():
        best = max(((len(a & sets[j]) / len(a | sets[j]), -j) for j in fit if j != i and a & sets[j]), default=(0.0, None))
        want[i] = (None if best[1] is None else -best[1], round(best[0], 9))
    bits = spark.createDataFrame([(i, b) for i, s in sets.items() for b in s], "entity long, bit string")
    found = graph.tanimoto_max(bits, spark.createDataFrame([(i,) for i in fit], "entity long")).collect()
    assert {r.entity: (r.nearest, round(r.similarity, 9)) for r in found} == want


def test_promoted_weights_follow_the_majority(spark):
    clusters = spark.createDataFrame([(i, i % 3, int(i in (0, 3, 1))) for i in range(9)], "feature_id int, fine int, coarse int")
    weights = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9)], "role string, coarse int, w double")
    got = {r.fine: (r.coarse, r.n, r.w) for r in ensemble.promote_weights(clusters, weights).collect()}
    assert got == {0: (1, 3, 0.9), 1: (0, 3, 0.1), 2: (0, 3, 0.1)}


def test_bootstrap_intervals_cover_the_mean(spark):
    rng = random.Random(9)
    rows = [("a", str(i), rng.gauss(5, 2)) for i in range(400)] + [("b", "1", 1.0), ("b", "2", 2.0), ("c", "1", None)]
    got = {r.key: r for r in helpers.bootstrap_ci(spark.createDataFrame(rows, "key string, sample_id string, value double"), "key", reps=300).collect()}
    values = [v for k, _, v in rows if k == "a"]
    half = 1.96 * (sum((v - sum(values) / 400) ** 2 for v in values) / 400) ** 0.5 / 20
    assert set(got) == {"a", "b"} and got["a"].n == 400 and math.isclose(got["a"].mean, sum(values) / 400)
    assert abs(got["a"].lo - (got["a"].mean - half)) < 0.3 * half and abs(got["a"].hi - (got["a"].mean + half)) < 0.3 * half
    assert got["b"].n == 2 and got["b"].lo is None and got["b"].hi is None


def test_gram_adds_up_partitions(spark):
    rows = [(i, [float(i), None if i == 3 else 1.0, i * 0.5]) for i in range(11)] + [(99, None)]
    got = {(r.a, r.b): (r.s, r.n) for r in helpers.gram(spark.createDataFrame(rows, "i int, v array<double>").repartition(3), "v").collect()}
    full = [[x or 0.0 for x in v] for _, v in rows if v]
    assert got == {(a, b): (sum(v[a] * v[b] for v in full), 11) for a in range(3) for b in range(3)}


def test_attach_block_rejects_unknown_entities(spark):
    rows, block = spark.createDataFrame([(1, "a"), (2, "b")], "i int, c string"), spark.createDataFrame([("a", 7)], "c string, n int")
    with pytest.raises(ValueError, match="b"):
        features.attach_block(rows, block, "c")
    assert [(r.i, r.n) for r in features.attach_block(rows, block, "c", strict=False).collect()] == [(1, 7)]
