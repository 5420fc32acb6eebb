"""Methods whose steps must all be there."""

import random

import numpy as np
import pytest
import test_queries

from assaylake.operators import factor, helpers
from assaylake.plans import extra, side, structure


def test_margin_is_a_weighted_sum_of_terms(spark):
    """Against sums in NumPy: terms cut to between 0 and 1, undefined values apart by model, a term that no sample has."""
    rng = random.Random(3)
    terms = [("t1", "all", 0.5), ("t2", "x", 0.3), ("t3", "y", 0.2)]
    values = {(m, t, str(i)): rng.uniform(*((-0.9, 0.7) if t == "t2" else (0, 1.2))) for m in "pq" for t in ("t1", "t2") for i in range(40) if rng.random() < 0.8}
    rows = [(*k, v) for k, v in values.items()] + [("p", "t1", "99", None), ("other", "t1", "0", 9.0)]
    table = spark.createDataFrame(rows, "model string, term string, sample_id string, value double").repartition(3)
    got = {r.term: r for r in helpers.margin_bootstrap(table, spark.createDataFrame(terms, "term string, split string, weight double"), "p", "q", reps=60).collect()}
    assert set(got) == {"t1", "t2", "t3", "margin"} and got["t3"].n == 0 and got["t3"].d == got["t3"].d_sd == 0

    def component(model, draw):
        out = {}
        for t, _, w in terms:
            mine = [(draw(i), v) for (m, x, i), v in values.items() if (m, x) == (model, t)]
            n = sum(k for k, _ in mine)
            out[t] = w * min(max(sum(k * v for k, v in mine) / n if n else 0.0, 0.0), 1.0)
        return out | {"margin": sum(out.values())}

    weights = {i: helpers.drawn(i, 60) for _, _, i in values}
    a, b = ([component(m, lambda i, k=k: weights[i][k]) for k in range(60)] for m in "pq")
    pa, pb = (component(m, lambda i: 1) for m in "pq")
    for t in got:
        x, y = np.array([v[t] for v in a]), np.array([v[t] for v in b])
        want = [pa[t], pb[t], pa[t] - pb[t], (x - y).mean(), (x - y).std(ddof=1), ((x - y).round(12) > 0).mean(), *np.quantile(x - y, [0.025, 0.975]), *np.quantile(x, [0.025, 0.975]), *np.quantile(y, [0.025, 0.975])]
        r = got[t]
        assert np.allclose([r.a, r.b, r.d, r.d_mean, r.d_sd, r.ahead, r.d_lo, r.d_hi, r.a_lo, r.a_hi, r.b_lo, r.b_hi], want, atol=1e-10)


def test_margin_takes_all_terms_of_means_over_samples(spark, monkeypatch):
    monkeypatch.setattr(test_queries, "SF", "/root/testdata/sf0.01")  # on less, residuals of lone samples are round-off
    assert abs(sum(w for *_, w in extra._margin_terms()) - 0.5875) < 1e-12 and len(extra._margin_terms()) == 9
    test_queries.test_query_equals_sql(spark, "sc_margin_bootstrap")


def _dense(pairs, n):
    w = np.zeros((n, n))
    for i, j, x in pairs:
        w[i, j] = w[j, i] = x
    d = w.sum(1)
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    return values[::-1][1:], vectors[:, ::-1][:, 1:], w / np.sqrt(np.outer(d, d))


def test_graph_eigenvectors_are_settled(spark, monkeypatch):
    """Held in one task by Lanczos steps, and spread over tiles: after four rounds they were near at best."""
    rng = np.random.default_rng(9)
    n = 150
    pairs = [(i, int(j), float(rng.integers(1, 9))) for i in range(n) for j in rng.choice(np.arange(i + 1, n), min(5, n - i - 1), replace=False)]
    want, _, a = _dense(pairs, n)
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    monkeypatch.setattr(factor, "DENSE", 0)
    for nodes in (1 << 17, 0):
        out, values, residual = factor.graph_eigenvectors(edges, 6, nodes=nodes)
        assert np.allclose(values, want[:6], atol=1e-10) and residual <= 1e-6
        y = np.array([r.y for r in out.orderBy("node").collect()])
        assert np.abs(a @ y - y * values).max() <= 2e-6 and np.allclose(y.T @ y, np.eye(6), atol=1e-9)
    with pytest.raises(RuntimeError):
        factor.graph_eigenvectors(edges, 6, nodes=0, max_rounds=1)


def test_krylov_against_dense():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 90))
    x, t = x + x.T, np.eye(90)[0]
    x[0] = x[:, 0] = 0
    want = np.linalg.eigvalsh(x[1:, 1:])[::-1]
    for width in (15, 60, 200):
        values, y, residual = factor.krylov(lambda v: x @ v, t, 5, 1e-8, width)
        assert np.allclose(values, want[:5]) and np.abs(x @ y - y * values).max() < 1e-7 and abs(t @ y).max() < 1e-12
    equal = (np.ones((40, 40)) - np.eye(40)) / 39  # one eigenvalue 39 times, any vector is closed
    values, y, _ = factor.krylov(lambda v: equal @ v, np.full(40, 40**-0.5), 5, 1e-6, 20)
    assert np.allclose(values, -1 / 39) and np.allclose(y.T @ y, np.eye(5))


def test_spectral_takes_all_vectors(spark):
    d = "/root/testdata/sf0.001"
    edges, nodes = side._sparse(spark, d)
    of = {r.node: i for i, r in enumerate(edges.selectExpr("src node").union(edges.selectExpr("dst node")).distinct().orderBy("node").collect())}
    want, *_ = _dense([(of[r.src], of[r.dst], float(r.weight)) for r in edges.collect()], len(of))
    got = {(r.place, r.eigenvalue) for r in structure.gr_spectral(spark, d).select("place", "eigenvalue").distinct().collect()}
    assert len(got) == min(64, len(of) - 2) and all(abs(want[i] - v) < 2e-6 for i, v in got)
