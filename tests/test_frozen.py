"""Fold baselines and fitted components against plain versions."""

import numpy as np

from assaylake.operators import frozen, helpers, splits


def test_fold_baselines_are_refits(spark):
    """Profiles within a fold, as frz_fold_baselines asks for them, against means over its fit rows."""
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"c{rng.integers(6)}", f"t{rng.integers(3)}", "train", "treatment") for i in range(80)]
    samples = spark.createDataFrame(rows, "sample_id string, compound string, strain string, split string, role string")
    cells = {(r[0], f): float(rng.normal()) for r in rows for f in ("a", "b") if rng.random() < 0.9}
    use = {(r.sample_id, r.fold): r.use for r in splits.fold_rows(samples, 3).collect()}
    folds = splits.fold_rows(samples, 3).select("sample_id", "fold", "use").join(samples, "sample_id")
    named = folds.selectExpr("concat_ws('@', sample_id, fold) AS sample_id", "cast(fold AS string) AS fold", "use", "compound", "strain")
    per_fold = spark.createDataFrame([(f"{s}@{k}", f, v) for (s, f), v in cells.items() for k in range(3)], "sample_id string, feature_id string, value double")
    got = frozen.hierarchical_mean(per_fold, named, [["fold", "compound"], ["fold"]], serve=named.where("use <> 'fit'"), fit=named.where("use = 'fit'")).collect()
    compound = {r[0]: r[1] for r in rows}
    assert got
    for r in got:
        s, k = r.sample_id.split("@")
        fit = [x for x in compound if use[x, int(k)] == "fit"]
        same = [x for x in fit if compound[x] == compound[s]]
        pool, level = (same, 1) if len(same) >= 3 else (fit, 2)
        values = [cells[x, r.feature_id] for x in pool if (x, r.feature_id) in cells]
        assert r.level == level and abs(r.mu - np.mean(values)) < 1e-12


def test_components_are_fitted_on_fit_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 6)) + 0.1 * rng.normal(size=(50, 6))
    fit = np.arange(50) % 4 != 0
    dense = spark.createDataFrame([(i, j, float(x[i, j]), bool(fit[i])) for i in range(50) for j in range(6)], "sample int, feature int, value double, fit boolean")
    scores, shares = helpers.pca(dense, dense.where("fit"), 3)
    mean = x[fit].mean(0)
    _, s, vt = np.linalg.svd(x[fit] - mean)
    sign = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    got = np.zeros((50, 3))
    for r in scores.collect():
        got[r.sample, r.component] = r.score
    assert np.allclose(got, (x - mean) @ (vt[:3].T * sign), atol=1e-8)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:3])
