"""Weights by regime, role and cluster of features, searched on the modules' exact total from co-moments alone.

A blend is base + sum of w[regime, role, cluster] * member. Every correlation and R2 of modules one to three is a
function of sums over cells that do not depend on the weights: of a sample for each cluster (a sample has one regime),
and of a feature for each regime (a feature has one cluster). These slices are made once; a candidate is a tensor of
weights, and many are scored in one pass over the slices, where they lie. The fourth module counts cells over a
threshold, is no function of such sums, and stays out of the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written
from assaylake.model import CONVENTIONS, MODULE_SPLITS, MODULE_WEIGHTS
from assaylake.operators.factor import packed_sum
from assaylake.operators.metrics import MIN_N

REGIMES = ["full", "chem_novel", "strain_novel", "both_novel"]
SPLITS = ["val_time", "val_chem_only", "val_strain_only", "val_both"]  # of the regimes, in their order
FAMILIES = ["y", "delta", "ctx", "drug"]
MODULES = [m for m in MODULE_WEIGHTS if m != "m4_dep"]
FLAT = 1e-10  # a variance up to it is none


def _sums(roles: list[str], t: Column, b: Column) -> list[Column]:
    f = [F.col(r) for r in roles]
    terms = [F.lit(1.0), t, t * t, b, b * b, t * b, *f, *[t * x for x in f], *[b * x for x in f], *[f[i] * f[j] for i in range(len(f)) for j in range(i, len(f))]]
    known = t.isNotNull() & b.isNotNull()
    return [F.coalesce(F.sum(F.when(known, x)), F.lit(0.0)) for x in terms]


def slices(cells: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, features): for each sample its regime and, by cluster, the sums of all families; for each feature its
    cluster and, by regime, the sums of y. Both are written tables.

    cells: (sample_id, feature_id, regime int, cluster int, y, control, d, mu_ctx, mu_drug, <roles>), of which mu_ctx and
    mu_drug may be null. Abundances are shifted by their mean, which changes no metric and keeps sums of squares small.
    """
    x = written(cells.withColumns({r: F.coalesce(r, F.lit(0.0)) for r in roles}), "blend-cells")
    shift = F.lit(float(x.agg(F.avg("y")).head()[0] or 0.0))
    zero = F.lit(0.0)
    d, y = F.col("d"), (F.col("y") - shift, F.col("control") - shift)
    by_family = [y, (d, zero), (d - F.col("mu_ctx"), -F.col("mu_ctx")), (d - F.col("mu_drug"), -F.col("mu_drug"))]
    s = x.groupBy("sample_id", "regime", "cluster").agg(F.array(*[v for t, b in by_family for v in _sums(roles, t, b)]).alias("sums"))
    s = s.groupBy("sample_id", "regime").agg(F.collect_list(F.struct("cluster", "sums")).alias("blocks"))
    f = x.groupBy("feature_id", "cluster", "regime").agg(F.array(*_sums(roles, *y)).alias("sums"))
    f = f.groupBy("feature_id", F.col("cluster").alias("own")).agg(F.collect_list(F.struct("regime", "sums")).alias("blocks"))
    return written(s.select("regime", "blocks"), "sample-slices"), written(f.select(F.col("own").alias("regime"), "blocks"), "feature-slices")


def _terms(w: np.ndarray) -> np.ndarray:
    """(sums, 3, candidates): what a slice's sums are multiplied by for P, PP and TP under weights (candidates, roles)."""
    count, k = w.shape
    i, j = np.triu_indices(k)
    out = np.zeros((6 + 3 * k + len(i), 3, count))
    out[3, 0], out[4, 1], out[5, 2] = 1, 1, 1
    out[6 : 6 + k, 0], out[6 + k : 6 + 2 * k, 2], out[6 + 2 * k : 6 + 3 * k, 1] = w.T, w.T, 2 * w.T
    out[6 + 3 * k :, 1] = (w[:, i] * w[:, j] * np.where(i == j, 1, 2)).T
    return out


def _moments(sums: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """(6, rows, candidates) of n, T, TT, P, PP, TP for rows (rows, blocks, sums), of which the blocks are added up, and
    terms (blocks, sums, 3, candidates)."""
    rows, count = len(sums), terms.shape[-1]
    fixed = np.broadcast_to(sums[..., :3].sum(axis=1).T[:, :, None], (3, rows, count))
    turned = (sums.reshape(rows, -1) @ terms.reshape(-1, 3 * count)).reshape(rows, 3, count)
    return np.concatenate([fixed, turned.transpose(1, 0, 2)])


def pcc_r2(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and R2 from moments (6, ...), NaN where they are undefined."""
    n, t, tt, p, pp, tp = m
    with np.errstate(all="ignore"):
        vt, vp, cov = tt - t * t / n, pp - p * p / n, tp - t * p / n
        enough = n >= MIN_N
        pcc = np.where(enough & (vt > FLAT * n) & (vp > FLAT * n), np.clip(cov / np.sqrt(vt * vp), -1, 1), np.nan)
        r2 = np.where(enough & (vt > FLAT * n), 1 - (tt - 2 * tp + pp) / vt, np.nan)
    return pcc, r2


def _folded(table: DataFrame, fold, shape: tuple[int, ...], blocks: int, rows: int = 256) -> np.ndarray:
    """What `fold` adds up over (regime or cluster, sums by block) of some slices at a time, packed by tasks and summed by
    Spark. A slice's sums lie at the place of their cluster or regime; where it has none there are zeros."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            owns = b.column(0).to_numpy(zero_copy_only=False)
            for own in np.unique(owns):
                at = np.flatnonzero(owns == own)
                for i in range(0, len(at), rows):
                    part = b.column(1).take(pa.array(at[i : i + rows]))
                    place, sums = part.flatten().flatten()
                    row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                    dense = np.zeros((len(part), blocks, len(sums.flatten()) // max(1, len(sums))))
                    dense[row, place.to_numpy()] = sums.flatten().to_numpy().reshape(len(row), -1)
                    fold(total, int(own), dense)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([1], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["one", "n", "data"])

    parts = table.select("regime", "blocks").mapInArrow(run, "one int, n long, data binary").withColumn("one", F.spark_partition_id() % 8)
    return sum((np.frombuffer(r.data, float).reshape(shape) for r in packed_sum(parts, "one").collect()), np.zeros(shape))


def evaluate(sliced: tuple[DataFrame, DataFrame], candidates: np.ndarray) -> dict[str, np.ndarray]:
    """{module: score of each candidate, "total": ...}; candidates: (candidates, regimes, roles, clusters).

    Candidates that have the same weights in a sample's regime, or for a feature's cluster, are scored there once; a
    batch of slices is one product of their sums and a matrix of the weights' terms.
    """
    count, regimes, _, clusters = candidates.shape
    families = len(FAMILIES)
    different = lambda w: np.unique(w.reshape(count, -1), axis=0, return_index=True, return_inverse=True)[1:]
    of_regime = [different(candidates[:, g]) for g in range(regimes)]
    of_cluster = [different(candidates[..., c]) for c in range(clusters)]

    def of_sample(total, regime, sums):
        at, back = of_regime[regime]
        terms = np.stack([_terms(candidates[at, regime, :, c]) for c in range(clusters)])
        for i, part in enumerate(np.split(sums, families, axis=2)):
            m = _moments(part, terms)
            pcc, _ = pcc_r2(m)
            found = np.concatenate([m.sum(axis=1), [np.nan_to_num(pcc).sum(axis=0), np.isfinite(pcc).sum(axis=0)]])
            total[regime, i] += found[:, back.ravel()]

    def of_feature(total, cluster, sums):
        at, back = of_cluster[cluster]
        scored = pcc_r2(_moments(sums, np.stack([_terms(candidates[at, g, :, cluster]) for g in range(regimes)])))
        for i, v in enumerate(scored):
            total[2 * i] += np.nan_to_num(v).sum(axis=0)[back.ravel()]
            total[2 * i + 1] += np.isfinite(v).sum(axis=0)[back.ravel()]

    by_split = _folded(sliced[0], of_sample, (len(REGIMES), families, 8, count), clusters)
    by_feature = _folded(sliced[1], of_feature, (4, count), regimes)

    def metric(name: str, split: str, family: str) -> np.ndarray:
        what, grain = name.removeprefix("ctx_").removeprefix("drug_").split("_")
        family = name.split("_")[0] if name.startswith(("ctx_", "drug_")) else family
        with np.errstate(all="ignore"):
            if grain == "feature":
                return by_feature[2 * (what == "r2")] / by_feature[2 * (what == "r2") + 1]
            at = by_split[:, FAMILIES.index(family)]
            at = at.sum(axis=0) if split == "all" else at[SPLITS.index(split)]
            return at[6] / at[7] if grain == "sample" else pcc_r2(at[:6])[what == "r2"]

    out, whole = {}, np.zeros(count)
    for module in MODULES:
        family = "y" if module == "m1_abundance" else "delta"
        score = sum(w * np.clip(np.nan_to_num(metric(name, MODULE_SPLITS[module], family)), 0, 1) for name, w in CONVENTIONS["per_sample_primary"][module].items())
        out[module] = score
        whole = whole + MODULE_WEIGHTS[module] * score
    return out | {"total": whole}


GRID = (0.0, 0.25, 0.5, 0.75, 1.0)


def promote(coarse: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Weights (regimes, roles, coarse clusters) for finer clusters, each with those of the one that contains it."""
    return coarse[:, :, parents]


def search(sliced: tuple[DataFrame, DataFrame], start: np.ndarray, to_fine: np.ndarray, rounds: int = 3, grid: tuple[float, ...] = GRID) -> tuple[np.ndarray, float]:
    """Non-negative weights (regimes, roles, clusters) by ascent from `start`, and their total; `to_fine` has the cluster
    of each cluster of the slices.

    A round scores every change of one weight at once, then all changes that help together, and takes what is best; it
    ends where nothing helps.
    """
    best, score = start, float(evaluate(sliced, promote(start, to_fine)[None])["total"][0])
    for _ in range(rounds):
        moves = []
        for at in np.ndindex(*best.shape):
            for g in grid:
                if g != best[at]:
                    moves.append((at, g))
        trials = np.repeat(best[None], len(moves), axis=0)
        for trial, (at, g) in zip(trials, moves, strict=True):
            trial[at] = g
        totals = evaluate(sliced, trials[..., to_fine])["total"]
        good = sorted(range(len(moves)), key=lambda i: (-round(totals[i], 12), i))
        good = [i for i in good if totals[i] > score + 1e-9]
        if not good:
            break
        together, taken = best.copy(), set()
        steps = [trials[good[0]]]
        for i in good:
            if moves[i][0] not in taken:
                taken.add(moves[i][0])
                together = together.copy()
                together[moves[i][0]] = moves[i][1]
                steps.append(together)
        ends = evaluate(sliced, np.stack(steps)[..., to_fine])["total"]
        top = int(np.argmax(np.round(ends, 12)))
        best, score = steps[top], float(ends[top])
    return best, score
