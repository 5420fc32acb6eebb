"""Steps whose rows must not grow with the product of two tables."""

import glob
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import test_query_equals_sql as equals_sql

from assaylake.functions import scratch
from assaylake.llm import substrings
from assaylake.operators import factor, graph, helpers, metrics
from assaylake.plans import common, extra


def test_reactions_of_the_same_enzymes_are_one_class(spark):
    sets = {1: "ab", 2: "b", 3: "ba", 4: "c", 5: "b", 6: "abc"}
    member, classes = extra.reaction_classes(spark.createDataFrame([(i, e) for i, es in sets.items() for e in es], "reaction int, enzyme string"))
    assert {r.reaction: r["class"] for r in member.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6}
    assert sorted((r["class"], r.feature_id) for r in classes.collect()) == [(1, "a"), (1, "b"), (2, "b"), (4, "c"), (6, "a"), (6, "b"), (6, "c")]


@pytest.mark.parametrize("name", ["kb_flux_penalty", "sc_round_sensitivity", "sc_dep_auprc", "sc_dep_rank"])
def test_equals_sql(spark, name):
    equals_sql(spark, name)


def test_nearest_sets_in_small_blocks(spark):
    """Equal to counting over many blocks, with sizes apart, copies, ties and sets alone; pairs of entities are never rows."""
    rng = random.Random(4)
    sets = {i: {f"b{int(rng.paretovariate(0.5)) % 90}" for _ in range(rng.choice([2, 9, 60]))} for i in range(70)}
    sets |= {100 + i: set(sets[i]) for i in range(9)} | {200: {"alone"}}
    rows = [(i, sorted(x), i % 5 != 0) for i, x in sets.items()] + [(300, [], True)]
    for block, common in ((7, 4), (2048, 1024)):
        table = spark.createDataFrame(rows, "entity long, set array<string>, fit boolean").repartition(3)
        got = {r.entity: (r.nearest, r.similarity) for r in graph.nearest_sets(table, block=block, common=common).collect()}
        for i, a in sets.items():
            best = max(((len(a & b) / len(a | b), -j) for j, b in sets.items() if j % 5 and j != i and a & b), default=(0.0, None))
            assert got.pop(i) == (None if best[1] is None else -best[1], best[0])
        assert not got


def test_nodes_with_many_edges_meet_a_tile_once(spark):
    rng = np.random.default_rng(5)
    found = {(h, 10 + i): float(rng.random()) for h in range(2) for i in range(400)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in found.items()], "src long, dst long, weight double")
    degrees = spark.createDataFrame([(h, h, 1.0, 400) for h in range(2)] + [(10 + i, 10 + i, 1.0, 2) for i in range(400)], "id long, node long, degree double, edges long")
    tiles, needs = factor._tiles(edges, degrees, size=100)
    assert tiles.count() == 8 and needs.count() == 400 + 2 * 8
    sent = needs.withColumn("y", F.array(F.col("id").cast("double"), F.lit(1.0)))
    parts = tiles.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(factor._tile_product, "id long, ay array<double>")
    got = {r.id: (r.a, r.b) for r in parts.groupBy("id").agg(F.sum(F.col("ay")[0]).alias("a"), F.sum(F.col("ay")[1]).alias("b")).collect()}
    for v in (0, 1, 10, 409):
        mine = [(b if a == v else a, w) for (a, b), w in found.items() if v in (a, b)]
        assert np.allclose(got[v], (sum(u * w for u, w in mine), sum(w for _, w in mine)))


def test_bootstrap_draws_a_sample_once_for_all_keys(spark):
    """Equal to sums row by row, and what is drawn is never a row: a task sends a row for each key and repetition."""
    rng = random.Random(6)
    rows = [(k, str(i), None if i % 7 == 0 else rng.random()) for k in ("a", "b", None) for i in range(30)]
    got = {r.k: r for r in helpers.bootstrap_ci(spark.createDataFrame(rows, "k string, sample_id string, value double").repartition(3), "k", reps=50).collect()}
    assert set(got) == {"a", "b"}
    for k in got:
        known = [(x, v) for kk, x, v in rows if kk == k and v is not None]
        means = []
        for rep in range(50):
            u = [int(hashlib.md5(f"42:{rep}:{x}".encode()).hexdigest()[:8], 16) / 2.0**32 for x, _ in known]
            w = [next((i for i, p in enumerate(helpers.POISSON) if y < p), len(helpers.POISSON)) for y in u]
            assert w == [helpers.drawn(x, 50)[rep] for x, _ in known]
            means.append(sum(a * v for a, (_, v) in zip(w, known, strict=True)) / sum(w))
        assert np.allclose([got[k].lo, got[k].hi], np.quantile(means, [0.025, 0.975]))


def test_cells_dealt_by_sample_are_shuffled_once(spark):
    """Ranks and sums of each model within a sample take the exchange of the cells, before these are made rows of models."""
    names = ["control", "mu_ctx", "mu_drug", "y", "d", *[m for m in common.MODELS if m != "control"]]
    cells = spark.createDataFrame([(str(i % 5), f"f{i}", i, "val_time", *([float(i)] * len(names))) for i in range(40)], ["sample_id", "feature_id", "feature_idx", "split", *names])
    x = common.as_predictions(common.by_sample(cells)).withColumnsRenamed({"d": "t", "d_pred": "p"})
    for f in (metrics.dep_counts, metrics.dep_rank, metrics.dep_auprc):
        plan = f(x, keys=("sample_id", "model"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_symbols_are_looked_for_once(spark):
    """An exploded array of flags was evaluated again by the filter put before it."""
    equals_sql(spark, "tx_named_entities")
    plan = extra.tx_named_entities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(extra.SYMBOLS)


def test_what_is_written_leaves_no_shuffle_behind(spark):
    folder = spark.conf.get("spark.local.dir")

    def shuffles():
        return set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))

    before = shuffles()
    out = scratch.written(spark.range(100_000).repartition(3, "id").groupBy("id").count(), "some")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert out.count() == 100_000
    scratch.drop(out)


def test_a_crowded_segment_has_one_row_of_owners(spark):
    """A row for each window met every occurrence of its segment."""
    windows = spark.createDataFrame([(1, 2, i, 10 + i, 0) for i in (2, 0, 1)] + [(3, 4, 0, 12, 0)], "seg1 long, seg2 long, shift int, d1 long, d2 long")
    found = spark.createDataFrame([(10 + i, 0, 0, [7 - i]) for i in range(3)], "seg1 long, seg2 long, shift int, owners array<long>")
    assert sorted(map(tuple, substrings._together(windows, found).collect())) == [(1, 2, 0, [7, 6, 5]), (3, 4, 0, [5])]
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join([f"a{i}", *base[i % 5 : 150 + i % 7], f"z{i}"])) for i in range(24)], "doc_id long, text string").repartition(5)
    few, many = (sorted((r["rank"], sorted(r.starts)) for r in substrings.repeated_windows(docs, crowded=c).collect()) for c in (1, 1500))
    assert few == many and len(few) == 23
