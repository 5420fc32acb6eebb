"""Cross-fitting against a plain fit of every fold and regime; folds against what they promise."""

import math

import numpy as np
import pytest

from assaylake.operators import crossfit, ranks, splits

K = 3


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"c{rng.integers(7)}", f"t{rng.integers(3)}", str([15, 60, 240][rng.integers(3)]), "train" if i % 9 else "val_time", "treatment") for i in range(150)]
    samples = spark.createDataFrame(rows, "sample_id string, compound string, strain string, pert_time string, split string, role string")
    effect = rng.normal(size=(7, 6))
    cells = [(s, f"f{j}", float(effect[int(c[1:]), j] + 0.3 * int(t[1:]) + rng.normal() * 0.5), float(rng.normal())) for s, c, t, *_ in rows for j in range(6) if rng.random() < 0.8]
    return samples, spark.createDataFrame(cells, "sample_id string, feature_id string, value double, control double"), rows, cells


def test_dev_rows(toy):
    samples, _, rows, _ = toy
    got = crossfit.dev_rows(samples, K).collect()
    assert sorted(r.sample_id for r in got) == sorted(r[0] for r in rows if r[4] == "train")
    for r in got:
        assert 0 <= r.dev < K
        assert {"full": r.dev not in (r.cf, r.sf), "chem_novel": r.dev == r.cf != r.sf, "strain_novel": r.dev == r.sf != r.cf, "both_novel": r.dev == r.cf == r.sf}[r.regime]
    assert len({r.regime for r in got}) == 4


def _plain(rows, cells, dev):
    """Encodings, fits and predictions fold by fold, cell by cell."""
    time = {r[0]: math.log1p(float(r[3])) for r in rows}
    out, fits = {}, {}
    known = [(s, f, v, c, dev[s]) for s, f, v, c in cells if s in dev]
    for fold in range(K):
        fit = [x for x in known if fold not in (x[4].cf, x[4].sf, x[4].dev)]

        def encoded(x, own, fit=fit):
            s, f, _, _, r = x
            mean = lambda keep, least: (lambda v: sum(v) / len(v) if len(v) >= least else None)([y[2] for y in fit if y[1] == f and keep(y[4]) and not (own and y[0] == s)])
            base = mean(lambda q: True, 1) or 0.0
            drug, strain = mean(lambda q: q.compound == r.compound, 3), mean(lambda q: q.strain == r.strain, 3)
            return [x[3], time[s], base, base if drug is None else drug, base if strain is None else strain]

        a, y = np.array([encoded(x, True) for x in fit]), np.array([x[2] for x in fit])
        for regime, blank in crossfit.BLANK.items():
            used = [i for i, c in enumerate(crossfit.COLUMNS) if c not in blank]
            mean, sd = a[:, used].mean(0), a[:, used].std(0)
            z = (a[:, used] - mean) / sd
            b = np.linalg.solve(z.T @ z / len(z) + 1e-3 * np.eye(len(used)), z.T @ (y - y.mean()) / len(z))
            fits[fold, regime] = lambda e, b=b, mean=mean, sd=sd, used=used, y=y: float((np.array(e)[used] - mean) / sd @ b + y.mean())
        for x in known:
            if x[4].dev == fold:
                e = encoded(x, False)
                out[x[0], x[1]] = (fits[fold, x[4].regime](e), fits[fold, "full"](e), x[2], x[4].regime)
    return out


def test_crossfit_against_plain(toy):
    samples, table, rows, cells = toy
    dev = {r.sample_id: r for r in crossfit.dev_rows(samples, K).collect()}
    want = _plain(rows, cells, dev)
    x = crossfit.design(table, crossfit.dev_rows(samples, K), K)
    got = crossfit.predict(x, crossfit.models(x)).collect()
    assert len(got) == len(want) == len({(r.sample_id, r.feature_id) for r in got})
    for r in got:
        pred, forced, *_ = want[r.sample_id, r.feature_id]
        assert abs(r.pred - pred) < 1e-8 and abs(r.forced - forced) < 1e-8
    for regime, penalty, mse, n in crossfit.trials(x, [1e-3, 1.0]):
        mine = [(p - v) ** 2 for p, _, v, g in want.values() if g == regime]
        assert n == len(mine)
        if penalty == 1e-3:
            assert abs(mse - np.mean(mine)) < 1e-8
    for (_, regime), (_, shares) in crossfit.models(x).items():
        assert abs(shares.sum() - 1) < 1e-9
        assert all(shares[crossfit.COLUMNS.index(c)] == 0 for c in crossfit.BLANK[regime])


def test_design_of_one_fold_is_a_part_of_the_whole_and_shuffles_no_copies(toy):
    samples, table, _, _ = toy
    rows = crossfit.dev_rows(samples, K)
    names = ["sample_id", "feature_id", "fold", "fit", "regime", "value", *crossfit.COLUMNS]
    whole = crossfit.design(table, rows, K)
    for folds in ([0], [1, 2]):
        got = {tuple(r)[:5]: tuple(r)[5:] for r in crossfit.design(table, rows, K, folds=folds).select(*names).collect()}
        want = {tuple(r)[:5]: tuple(r)[5:] for r in whole.select(*names).collect() if r.fold in folds}
        assert set(got) == set(want) and all(np.allclose(got[x], want[x], atol=1e-9) for x in want)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_trials_read_the_design_once(toy, spark, monkeypatch):
    samples, table, _, _ = toy
    x, asked, plain = crossfit.design(table, crossfit.dev_rows(samples, K), K), [], crossfit.comoments
    monkeypatch.setattr(crossfit, "comoments", lambda t, *keys: asked.append(keys) or plain(t, *keys))
    assert len(crossfit.trials(x, [1.0])) == 4 and len(asked) == 1


def test_boosted_specialists(toy):
    samples, table, _, _ = toy
    x = crossfit.design(table, crossfit.dev_rows(samples, K), K)
    pred, importance = crossfit.boosted(x, 1, rounds=3)
    got = pred.collect()
    dev = x.where("fold = 1 AND NOT fit").collect()
    assert sorted((r.sample_id, r.feature_id, r.regime) for r in got) == sorted((r.sample_id, r.feature_id, r.regime) for r in dev)
    for regime, shares in importance.items():
        assert abs(sum(shares) - 1) < 1e-9
        assert all(shares[crossfit.COLUMNS.index(c)] == 0 for c in crossfit.BLANK[regime])
    mean = np.mean([r.value for r in x.where("fold = 1 AND fit").collect()])
    assert np.mean([(r.pred - r.value) ** 2 for r in got]) < np.mean([(mean - r.value) ** 2 for r in got])


def test_group_folds_and_fit_masks(toy):
    samples, _, rows, _ = toy
    train = [r for r in rows if r[4] == "train"]
    compounds, strains = (x.collect() for x in splits.group_folds(samples, K))
    load = [sum(sum(r[1] == c.compound for r in train) for c in compounds if c.fold == f) for f in range(K)]
    assert sorted(c.compound for c in compounds) == sorted({r[1] for r in train}) and sum(load) == len(train)
    assert max(load) - min(load) <= max(sum(r[1] == c for r in train) for c in {r[1] for r in train})
    assert {s.strain: s.fold for s in strains} == {s: i % K for i, s in enumerate(sorted({r[2] for r in train}))}
    cf, sf = {c.compound: c.fold for c in compounds}, {s.strain: s.fold for s in strains}
    uses = {(r.sample_id, r.fold): r.use for r in splits.fold_rows(samples, K).collect()}
    assert len(uses) == K * len(train)
    for s, c, t, *_ in train:
        for f in range(K):
            want = "both_novel" if cf[c] == f == sf[t] else "chem_novel" if cf[c] == f else "strain_novel" if sf[t] == f else "fit"
            assert uses[s, f] == want


def test_percentiles_over_ranges(spark):
    rng = np.random.default_rng(3)
    values = {k: np.where(rng.random(n) < 0.4, 1.5, rng.normal(size=n)) for k, n in (("hot", 4000), ("b", 50), ("one", 1))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)], "k string, v double").repartition(7)
    r = ranks.value_ranks(df, "v", "k")
    shares = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {x.k: x for x in ranks.percentiles(r, "v", shares, "k").collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k].n == len(vs) and np.allclose(got[k].q, np.quantile(vs, shares))
    stats = {x.k: x for x in ranks.moments(r, "v", "k").collect()}
    assert all(abs(stats[k].mean - vs.mean()) < 1e-12 and abs(stats[k].sd - vs.std()) < 1e-12 for k, vs in values.items())
    whole = ranks.value_ranks(df, "v")
    assert np.allclose(ranks.percentiles(whole, "v", shares).first().q, np.quantile(np.concatenate(list(values.values())), shares))
    assert whole.where("v = 1.5").first().n == sum((vs == 1.5).sum() for vs in values.values())
    assert ranks.percentiles(ranks.value_ranks(df.where("false"), "v", "k"), "v", shares, "k").count() == 0
