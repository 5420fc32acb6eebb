"""Shared steps of the scores that make each cell once, against the longer ways and SQL."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_queries import test_query_equals_sql as equals_sql

from assaylake.functions import fixtures as fx
from assaylake.operators import ensemble, metrics, normalize


def test_median_normalise_joins_no_medians(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", f"f{j}", rng.choice([None, 1.0, 1.0, 2.5, rng.random()])) for i in range(12) for j in range(i)]
    samples = spark.createDataFrame([(f"s{i}", "train" if i % 3 else "val_time") for i in range(13)], "sample_id string, split string")
    out = normalize.median_normalise(spark.createDataFrame(rows, "sample_id string, feature_id string, value double").repartition(5), samples)
    of = {}
    for s, _, v in rows:
        of.setdefault(s, []).extend([] if v is None else [v])
    medians = {s: statistics.median(v) for s, v in of.items() if v}
    ref = statistics.median(m for s, m in medians.items() if int(s[1:]) % 3)
    got = {(r.sample_id, r.feature_id): r.value for r in out.collect()}
    assert set(got) == {(s, f) for s, f, v in rows if v is not None}
    assert all(abs(got[s, f] - (v - medians[s] + ref)) < 1e-12 for s, f, v in rows if v is not None)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_cells_are_grouped_by_sample_without_another_shuffle(spark):
    one = fx.cells(spark, "/root/testdata/sf0.001").groupBy("sample_id").count()
    assert one._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(sample_id") == 1


def test_metrics_of_one_sort_equal_those_of_three(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0.0, 0.5, 1.5, -1.5, -2.0, rng.uniform(-3, 3)])
    rows = [(f"s{i}", j, 0.1 if i == 0 else value(), value()) for i in range(30) for j in range(i % 9)]
    pairs = spark.createDataFrame(rows, "sample_id string, feature_idx int, t double, p double")
    counts, rank, area = ({r.sample_id: r for r in f(pairs).collect()} for f in (metrics.dep_counts, metrics.dep_rank, metrics.dep_auprc))
    got = {r.sample_id: r for r in metrics.dep_metrics(pairs).collect()}
    assert set(got) == set(counts) and rank and set(rank) < set(got)
    for s, r in got.items():
        assert all(r[c] == counts[s][c] for c in counts[s].__fields__)
        assert r.recall_at_k == (rank[s].recall_at_k if s in rank else None)
        assert (r.auprc is None) if s not in area else abs(r.auprc - area[s].auprc) < 1e-12


def test_blend_of_wide_equals_the_blend_of_members(spark):
    rng = random.Random(7)
    rows = [(f"s{i}", f"f{j}", j % 2, rng.choice([None, rng.random()]), rng.random()) for i in range(6) for j in range(5)]
    wide = spark.createDataFrame(rows, "sample_id string, feature_id string, cluster int, a double, b double")
    weights = spark.createDataFrame([("full", m, c, v + 0.1 * c) for m, v in (("a", 0.6), ("b", 0.3)) for c in (0, 1)], "regime string, role string, cluster int, w double")
    members = wide.unpivot(["sample_id", "feature_id", "cluster"], ["a", "b"], "role", "value").withColumn("regime", F.lit("full"))
    key = lambda x: {(r.sample_id, r.feature_id): round(r.blend, 12) for r in x.collect()}
    out = ensemble.blend_of_wide(wide, {m: F.lit(v) + 0.1 * F.col("cluster") for m, v in (("a", 0.6), ("b", 0.3))})
    assert key(out) == key(ensemble.weighted_blend(members, weights)) and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sc_detection_subcohort", "sc_masked_losses", "vf_score_consistency", "en_weighted_blend", "tf_median_normalise"])
def test_equals_sql(spark, name):
    equals_sql(spark, name)
