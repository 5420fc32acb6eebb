"""Module scores of weight tensors from slices against scores of the blended cells themselves."""

import numpy as np

from assaylake.model import CONVENTIONS, MODULE_SPLITS, MODULE_WEIGHTS
from assaylake.operators import blending

ROLES = ["a", "b"]


def _cells(seed=1, samples=32, features=9, clusters=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(samples):
        for j in range(features):
            if rng.random() < 0.75:
                control, d = rng.normal(15), rng.normal()
                ctx = None if rng.random() < 0.1 else float(d * 0.3 + rng.normal() * 0.2)
                out.append((f"s{i}", f"f{j}", i % 4, j % clusters, float(control + d), float(control), float(d), ctx, float(rng.normal() * 0.2), float(d * 0.5 + rng.normal()), None if rng.random() < 0.05 else float(d + rng.normal())))
    return out


SCHEMA = "sample_id string, feature_id string, regime int, cluster int, y double, control double, d double, mu_ctx double, mu_drug double, a double, b double"


def _pcc(t, p):
    return None if len(t) < 3 or np.ptp(t) == 0 or np.ptp(p) == 0 else float(np.corrcoef(t, p)[0, 1])


def _r2(t, p):
    return None if len(t) < 3 or np.ptp(t) == 0 else float(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())


def _exact(cells, w):
    """From blended cells, without sums."""
    rows = []
    for s, f, regime, cluster, y, control, d, ctx, drug, a, b in cells:
        p = w[regime, 0, cluster] * (a or 0.0) + w[regime, 1, cluster] * (b or 0.0)
        families = {"y": (y, control + p), "delta": (d, p), "ctx": None if ctx is None else (d - ctx, p - ctx), "drug": (d - drug, p - drug)}
        rows.append((s, f, blending.SPLITS[regime], families))

    def metric(name, split, family):
        what, grain = name.removeprefix("ctx_").removeprefix("drug_").split("_")
        family = name.split("_")[0] if name.startswith(("ctx_", "drug_")) else family
        groups: dict = {}
        for s, f, sp, families in rows:
            if families[family] is not None and split in ("all", sp):
                groups.setdefault({"pooled": "", "sample": s, "feature": f}[grain], []).append(families[family])
        found = [{"pcc": _pcc, "r2": _r2}[what](*np.array(g).T) for g in groups.values()]
        found = [v for v in found if v is not None]
        return min(max(float(np.mean(found)), 0), 1) if found else 0.0

    out = {m: sum(k * metric(name, MODULE_SPLITS[m], "y" if m == "m1_abundance" else "delta") for name, k in CONVENTIONS["per_sample_primary"][m].items()) for m in blending.MODULES}
    return out | {"total": sum(MODULE_WEIGHTS[m] * v for m, v in out.items())}


def test_scores_from_slices_equal_exact_scores(spark):
    cells, rng = _cells(), np.random.default_rng(4)
    sliced = blending.slices(spark.createDataFrame(cells, SCHEMA).repartition(5), ROLES)
    flat = np.repeat(rng.uniform(0.1, 0.6, (4, 2, 1)), 3, axis=2)
    one_off = rng.uniform(0, 0.9, (4, 2, 3))
    one_off[:, :, 0] = 0
    turns = np.zeros((4, 2, 3))
    turns[:, :, ::2] = 1.2
    tensors = np.stack([np.zeros((4, 2, 3)), flat, one_off, rng.uniform(0, 1, (4, 2, 3)), turns])
    got = blending.evaluate(sliced, tensors)
    for i, w in enumerate(tensors):
        want = _exact(cells, w)
        assert all(abs(got[m][i] - want[m]) < 1e-6 for m in want), (i, {m: (got[m][i], want[m]) for m in want})


def test_search_improves_and_promotes(spark):
    cells = _cells(2)
    sliced = blending.slices(spark.createDataFrame(cells, SCHEMA), ROLES)
    start = np.full((4, 2, 1), 0.5)
    coarse, score = blending.search(sliced, start, np.zeros(3, int), rounds=2)
    assert score >= _exact(cells, blending.promote(start, np.zeros(3, int)))["total"] - 1e-9
    assert abs(score - _exact(cells, blending.promote(coarse, np.zeros(3, int)))["total"]) < 1e-6
    fine, finer = blending.search(sliced, blending.promote(coarse, np.zeros(3, int)), np.arange(3), rounds=1)
    assert finer >= score - 1e-9 and fine.shape == (4, 2, 3) and fine.min() >= 0
    alone = [_exact(cells, w)["total"] for at in np.ndindex(4, 2, 3) for g in blending.GRID for w in [blending.promote(coarse, np.zeros(3, int)).copy()] if not w.__setitem__(at, g)]
    assert finer >= max(alone) - 1e-6


def test_a_batch_of_slices_is_one_product():
    """Moments of many slices under many weights at once, from sums of cells, against those of the blended cells."""
    rng = np.random.default_rng(9)
    cells = rng.normal(size=(5, 3, 7, 4))  # slices, clusters, cells, (t, b, two roles)
    t, b, f = cells[..., 0], cells[..., 1], cells[..., 2:]
    i, j = np.triu_indices(2)
    sums = np.concatenate([np.stack([t * 0 + 1, t, t * t, b, b * b, t * b], -1), f, t[..., None] * f, b[..., None] * f, f[..., i] * f[..., j]], -1).sum(axis=2)
    sums[2, 1] = 0  # a slice without a cell in a cluster
    w = rng.uniform(size=(6, 2, 3))
    got = blending._moments(sums, np.stack([blending._terms(w[..., c]) for c in range(3)]))
    for row in range(5):
        for k in range(6):
            used = [c for c in range(3) if (row, c) != (2, 1)]
            x = np.concatenate([t[row, c] for c in used])
            p = np.concatenate([b[row, c] + f[row, c] @ w[k, :, c] for c in used])
            assert np.allclose(got[:, row, k], [len(x), x.sum(), x @ x, p.sum(), p @ p, x @ p])
