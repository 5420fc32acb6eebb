"""Out-of-fold predictions by specialists: each development row is predicted once, by the model of its fold and regime.

A fold holds out a group of compounds and a strain. A row is developed in one fold, as `full` (the fold holds neither of
its entities, only the row itself), `chem_novel`, `strain_novel` or `both_novel`; the fold's models are fitted on rows
of none of the held-out entities. A specialist does without what its regime cannot know.

The models are ridge regressions on encodings. All of a fold's specialists come from one table of co-moments, of which
a specialist leaves out rows and columns, so the cells are read once for all folds and regimes; what reaches the driver
is one row of sums for each fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written
from assaylake.operators.features import MIN_CELLS
from assaylake.operators.splits import group_folds, seeded

COLUMNS = ["control", "time", "feature_mean", "drug_mean", "strain_mean"]
BLANK = {"full": (), "chem_novel": ("drug_mean",), "strain_novel": ("strain_mean",), "both_novel": ("drug_mean", "strain_mean")}


def dev_rows(samples: DataFrame, k: int = 5, full: float = 0.1, chem: float = 0.5) -> DataFrame:
    """(sample_id, compound, strain, cf, sf, dev, regime): the folds that hold out a train row's compound and strain, the
    one fold in which the row is developed, and as what. Shares are drawn by a seeded hash of the row.
    """
    compounds, strains = group_folds(samples, k)
    train = samples.where("split = 'train' AND role = 'treatment'")
    x = train.join(F.broadcast(compounds.withColumnRenamed("fold", "cf")), "compound").join(F.broadcast(strains.withColumnRenamed("fold", "sf")), "strain")
    draw = lambda what: F.conv(F.substring(seeded(F.concat(F.lit(what), F.col("sample_id"))), 1, 8), 16, 10).cast("double") / 2.0**32
    other = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: (f != F.col("cf")) & (f != F.col("sf")))
    carved = (draw("full:") < full) & (F.size(other) > 0)
    regime = F.when(carved, "full").when(F.col("cf") == F.col("sf"), "both_novel").when(draw("chem:") < chem, "chem_novel").otherwise("strain_novel")
    place = F.least(F.floor(draw("fold:") * F.size(other)), F.size(other) - 1).cast("int") + 1
    dev = F.when(F.col("regime") == "full", F.element_at(other, place)).when(F.col("regime") == "strain_novel", F.col("sf")).otherwise(F.col("cf"))
    return x.withColumn("regime", regime).withColumn("dev", dev).select("sample_id", "compound", "strain", "pert_time", "cf", "sf", "dev", "regime")


def _fitted_in(folds: list[int]) -> Column:
    """Those of the folds whose models may see a row."""
    return F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: (f != F.col("cf")) & (f != F.col("sf")) & (f != F.col("dev")))


def design(cells: DataFrame, rows: DataFrame, k: int = 5, folds: list[int] | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """(sample_id, feature_id, fold, fit, regime, value, <COLUMNS>): a cell in each fold that fits on it, and in the one
    that develops it; with `folds` only the rows of those. cells: (sample_id, feature_id, value, control).

    Encodings are means over a fold's fit cells, without the cell itself where it is one of them; under three cells they
    give way to the feature's mean. They come from sums by entities and held-out folds, made once and few, not from cells
    that are copied for each fold; they are counted, so that the copies are not shuffled to meet them.
    """
    folds = list(range(k)) if folds is None else folds
    x = written(cells.select("sample_id", "feature_id", "value", "control").join(rows, "sample_id"), "dev-cells")
    parts = written(x.groupBy("compound", "strain", "feature_id", "cf", "sf", "dev").agg(F.sum("value").alias("s"), F.count("value").alias("n")), "dev-sums")

    def sums(entity: str | None, name: str) -> DataFrame:
        keys = [entity, "feature_id"] if entity else ["feature_id"]
        found = parts.withColumn("fold", F.explode(_fitted_in(folds))).groupBy(*keys, "fold").agg(F.sum("s").alias(f"{name}_s"), F.sum("n").alias(f"{name}_n"))
        found = written(found, f"{name}-sums")
        return F.broadcast(found) if found.count() <= broadcast_rows else found

    developed = F.when(F.col("dev").isin(folds), F.array("dev")).otherwise(F.array().cast("array<int>"))
    both = F.array_union(_fitted_in(folds), developed)
    y = x.withColumn("fold", F.explode(both)).withColumn("fit", F.col("fold") != F.col("dev"))
    y = y.join(sums(None, "feature"), ["feature_id", "fold"], "left").join(sums("compound", "drug"), ["compound", "feature_id", "fold"], "left").join(sums("strain", "strain"), ["strain", "feature_id", "fold"], "left")
    own = F.col("fit").cast("int")

    def mean(name: str, at_least: int) -> Column:
        n = F.coalesce(F.col(f"{name}_n"), F.lit(0)) - own
        return F.when(n >= at_least, (F.col(f"{name}_s") - own * F.col("value")) / n)

    y = y.withColumn("feature_mean", F.coalesce(mean("feature", 1), F.lit(0.0)))
    encoded = [F.coalesce(mean(n, MIN_CELLS), F.col("feature_mean")).alias(f"{n}_mean") for n in ("drug", "strain")]
    return y.select("sample_id", "feature_id", "fold", "fit", "regime", "value", "control", F.log1p(F.col("pert_time").cast("double")).alias("time"), "feature_mean", *encoded)


def comoments(table: DataFrame, *keys: str) -> dict[tuple, np.ndarray]:
    """{keys: sums of products of 1, the columns and the value}, one row of sums for each key."""
    z = [F.lit(1.0), *[F.col(c) for c in COLUMNS], F.col("value")]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    rows = table.groupBy(*keys).agg(*[F.sum(z[i] * z[j]).alias(f"p{n}") for n, (i, j) in enumerate(pairs)]).collect()
    out: dict[tuple, np.ndarray] = {}
    for r in rows:
        m = np.zeros((len(z), len(z)))
        for n, (i, j) in enumerate(pairs):
            m[i, j] = m[j, i] = r[f"p{n}"]
        out[tuple(r[k] for k in keys)] = m
    return out


def ridge(m: np.ndarray, regime: str, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(intercept and weights of COLUMNS, shares of importance) from co-moments: on standardised columns, those that the
    regime blanks and those that never change with a weight of 0. Importance is the absolute standardised weight."""
    n, p = m[0, 0], len(COLUMNS)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
    used = [i for i, c in enumerate(COLUMNS) if c not in BLANK[regime] and sd[i] > 1e-9]
    weights, shares = np.zeros(p + 1), np.zeros(p)
    if used:
        scaled = cov[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        b = np.linalg.solve(scaled + penalty * np.eye(len(used)), cov[used, p] / sd[used])
        weights[1 + np.array(used)] = b / sd[used]
        if np.abs(b).sum() > 0:
            shares[used] = np.abs(b) / np.abs(b).sum()
    weights[0] = mean[p] - weights[1:] @ mean[:p]
    return weights, shares


def models(table: DataFrame, penalty: float = 1e-3) -> dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]:
    """{(fold, regime): ridge()} of every specialist, from one aggregate over the fit cells of all folds."""
    return {(fold, g): ridge(m, g, penalty) for (fold,), m in comoments(table.where("fit"), "fold").items() for g in BLANK}


def predict(table: DataFrame, fitted: dict, forced: str = "full") -> DataFrame:
    """(sample_id, feature_id, fold, regime, value, pred, forced): each development cell by its regime's specialist, and
    by the `forced` one whatever its regime."""
    names = ["intercept", *COLUMNS]
    rows = [(f, g, *map(float, w)) for (f, g), (w, _) in fitted.items()]
    spark = table.sparkSession
    weights = spark.createDataFrame(rows, "fold int, regime string, " + ", ".join(f"w_{n} double" for n in names))  # folds times regimes
    other = weights.where(F.col("regime") == forced).drop("regime").toDF("fold", *[f"f_{n}" for n in names])
    dot = lambda p: sum((F.col(f"{p}_{c}") * F.col(c) for c in COLUMNS), F.col(f"{p}_intercept"))
    x = table.where("NOT fit").join(F.broadcast(weights), ["fold", "regime"]).join(F.broadcast(other), "fold")
    return x.select("sample_id", "feature_id", "fold", "regime", "value", dot("w").alias("pred"), dot("f").alias("forced"))


def trials(table: DataFrame, penalties: list[float]) -> list[tuple[str, float, float, int]]:
    """(regime, penalty, mse, n) of every penalty on the development cells of each regime, from co-moments of fit and of
    development cells alone, which one aggregate over the table gives: no cell is read again for a candidate."""
    sums = comoments(table.withColumn("regime", F.when(~F.col("fit"), F.col("regime"))), "fold", "fit", "regime")
    fit = {(fold,): m for (fold, fitted, _), m in sums.items() if fitted}
    dev = {(fold, regime): m for (fold, fitted, regime), m in sums.items() if not fitted}
    out = []
    for g in BLANK:
        for penalty in penalties:
            error, n = 0.0, 0.0
            for (fold, regime), m in dev.items():
                if regime == g and (fold,) in fit:
                    w = np.append(ridge(fit[fold,], g, penalty)[0], -1.0)  # prediction minus value
                    error, n = error + float(w @ m @ w), n + m[0, 0]
            if n:
                out.append((g, penalty, float(error / n), int(n)))
    return out


def boosted(table: DataFrame, fold: int, rounds: int = 5, depth: int = 3, seed: int = 42) -> tuple[DataFrame, dict[str, list[float]]]:
    """(sample_id, feature_id, regime, value, pred) of a fold's development cells by gradient-boosted trees, one model for
    each regime over all of the fold's fit cells, and each model's importance of COLUMNS. A specialist's blank columns are
    constant to it, when it is fitted and when it predicts. The table is read for each regime, so it should be a written one."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    def seen(x: DataFrame, regime: str) -> DataFrame:
        kept = [F.lit(0.0).alias(c) if c in BLANK[regime] else F.col(c) for c in COLUMNS]
        return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(x.select("sample_id", "feature_id", "regime", "value", *kept))

    fit = table.where((F.col("fold") == fold) & F.col("fit"))
    dev = table.where((F.col("fold") == fold) & ~F.col("fit"))
    out, importance = None, {}
    for regime in BLANK:
        model = GBTRegressor(labelCol="value", featuresCol="features", predictionCol="pred", maxIter=rounds, maxDepth=depth, seed=seed).fit(seen(fit, regime))
        importance[regime] = model.featureImportances.toArray().tolist()
        part = model.transform(seen(dev.where(F.col("regime") == regime), regime)).select("sample_id", "feature_id", "regime", "value", "pred")
        out = part if out is None else out.unionByName(part)
    return out, importance
