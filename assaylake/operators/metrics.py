"""Masked metrics at three grains, detection of strong responders, modules and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions.scratch import written
from assaylake.model import CONVENTIONS, MODULE_SPLITS, MODULE_WEIGHTS

MIN_N = 3


def moment_aggregates(t: str = "t", p: str = "p") -> list[Column]:
    """Aggregates over rows where both are there; centred moments, so that round-off does not look like variance."""
    both = F.col(t).isNotNull() & F.col(p).isNotNull()
    x, y = F.when(both, F.col(t)), F.when(both, F.col(p))
    return [F.count(x).alias("n"), F.covar_pop(x, y).alias("cov"), F.var_pop(x).alias("var_t"), F.var_pop(y).alias("var_p"), F.min(x).alias("min_t"), F.max(x).alias("max_t"), F.min(y).alias("min_p"), F.max(y).alias("max_p"), F.sum((x - y) * (x - y)).alias("ss_res")]


def pcc() -> Column:
    defined = (F.col("n") >= MIN_N) & (F.col("min_t") < F.col("max_t")) & (F.col("min_p") < F.col("max_p"))
    return F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("var_t") * F.col("var_p")))))


def r2() -> Column:
    return F.when((F.col("n") >= MIN_N) & (F.col("min_t") < F.col("max_t")), 1 - F.col("ss_res") / (F.col("n") * F.col("var_t")))


def moments(pairs: DataFrame, *keys: str) -> DataFrame:
    """One pass with grouping sets: pooled, by sample and by feature, for each of `keys`.

    (keys, grain, id, moments). Each cell is expanded to three rows before the partial aggregate, which folds them
    on the map side; what is shuffled is a row per group and task.
    """
    rows = pairs.select(*keys, "t", "p", F.inline(F.array(F.struct(F.lit("pooled").alias("grain"), F.lit("").alias("id")), F.struct(F.lit("sample").alias("grain"), F.col("sample_id").alias("id")), F.struct(F.lit("feature").alias("grain"), F.col("feature_id").alias("id")))))
    return rows.groupBy(*keys, "grain", "id").agg(*moment_aggregates())


def scores(pairs: DataFrame, *keys: str) -> DataFrame:
    return moments(pairs, *keys).select(*keys, "grain", "id", "n", pcc().alias("pcc"), r2().alias("r2"))


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Moments of groups put together: sums within groups plus those between them, about the common mean."""
    n, mt, mp = F.col("n"), F.col("mean_t"), F.col("mean_p")
    total = lambda c: F.sum(n * c)
    names = ["min_t", "max_t", "min_p", "max_p"]
    ends = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in names]
    x = parts.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n_"), total(mt).alias("st"), total(mp).alias("sp"), total(F.col("var_t") + mt * mt).alias("stt"), total(F.col("var_p") + mp * mp).alias("spp"), total(F.col("cov") + mt * mp).alias("stp"), F.sum("ss_res").alias("ss_res"), *ends)
    mean = lambda c: F.col(c) / F.col("n_")
    spread = lambda c, a, b: F.greatest(F.lit(0.0), mean(c) - mean(a) * mean(b))
    return x.select(*keys, F.col("n_").alias("n"), mean("st").alias("mean_t"), mean("sp").alias("mean_p"), (mean("stp") - mean("st") * mean("sp")).alias("cov"), spread("stt", "st", "st").alias("var_t"), spread("spp", "sp", "sp").alias("var_p"), *names, "ss_res")


def scores_by_split(pairs: DataFrame, *keys: str, dealt: DataFrame | None = None) -> DataFrame:
    """scores() of every split and of 'all', for pairs (keys, split, sample_id, feature_id, t, p).

    Cells are aggregated twice, by sample (from `dealt`, if given: the same rows dealt by sample) and by feature; a sample has one split, and what is pooled, or of all splits,
    is put together from those moments. The result has no groups without a shared cell.
    """
    aggs = [*moment_aggregates(), F.avg(F.when(F.col("p").isNotNull(), F.col("t"))).alias("mean_t"), F.avg(F.when(F.col("t").isNotNull(), F.col("p"))).alias("mean_p")]
    whole = F.lit("all").alias("split")
    by_sample = written((pairs if dealt is None else dealt).groupBy(*keys, "split", F.col("sample_id").alias("id")).agg(*aggs), "moments-of-samples")
    by_feature = written(pairs.groupBy(*keys, "split", F.col("feature_id").alias("id")).agg(*aggs), "moments-of-features")
    pooled = written(_merged(by_sample, *keys, "split").withColumn("id", F.lit("")), "moments-pooled")
    every = by_sample.columns
    several = lambda x, *more: _merged(x, *keys, *more).withColumn("split", whole)
    parts = [("sample", by_sample), ("sample", by_sample.withColumn("split", whole)), ("feature", by_feature), ("feature", several(by_feature, "id")), ("pooled", pooled), ("pooled", several(pooled).withColumn("id", F.lit("")))]
    out = None
    for grain, x in parts:
        x = x.select(*every).withColumn("grain", F.lit(grain))
        out = x if out is None else out.unionByName(x)
    return out.where("n > 0").select(*keys, "split", "grain", "id", "n", pcc().alias("pcc"), r2().alias("r2"))


def summarise(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, grain, mean, median, defined and undefined counts of pcc and r2)"""
    aggs = [a for m in ("pcc", "r2") for a in (F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"), F.count(m).alias(f"{m}_defined"), (F.count("*") - F.count(m)).alias(f"{m}_undefined"))]
    return scored.groupBy(*keys, "grain").agg(*aggs)


def dep_counts(pairs: DataFrame, threshold: float = 1.0, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """By sample of at least three shared cells: positives, tp, fp, fn, precision, recall, F1."""
    both = pairs.where("t IS NOT NULL AND p IS NOT NULL")
    y, yhat = F.abs("t") > threshold, F.abs("p") > threshold
    n = lambda c: F.sum(c.cast("long"))
    g = both.groupBy(*keys).agg(F.count("*").alias("n"), n(y).alias("n_pos"), n(y & yhat).alias("tp"), n(~y & yhat).alias("fp"), n(y & ~yhat).alias("fn")).where(F.col("n") >= MIN_N)
    return g.withColumns(_ratios())


def _ratios() -> dict[str, Column]:
    some = F.col("n_pos") > 0
    return {"precision": F.when(some & (F.col("tp") + F.col("fp") > 0), F.col("tp") / (F.col("tp") + F.col("fp"))), "recall": F.when(some, F.col("tp") / F.col("n_pos")), "f1": F.when(some, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))}


def _ranked_samples(pairs: DataFrame, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    """Cells of samples that have both classes, with y and the ranking score; n_pos and n beside them."""
    both = pairs.where("t IS NOT NULL AND p IS NOT NULL").select(*keys, "feature_idx", (F.abs("t") > threshold).cast("int").alias("y"), F.abs("p").alias("score"))
    w = Window.partitionBy(*keys)
    return both.withColumns({"n": F.count("*").over(w), "n_pos": F.sum("y").over(w)}).where((F.col("n") >= MIN_N) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")))


def dep_rank(pairs: DataFrame, threshold: float = 1.0, fixed_k: int = 100, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """recall_at_k with K the sample's number of positives, and with a fixed K; ties by the feature's place."""
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "feature_idx"))
    x = _ranked_samples(pairs, threshold, keys).withColumn("rk", rk)
    hits = lambda k: F.sum(F.when(F.col("rk") <= k, F.col("y")).otherwise(0)) / F.max("n_pos")
    return x.groupBy(*keys).agg(hits(F.col("n_pos")).alias("recall_at_k"), hits(F.lit(fixed_k)).alias("recall_at_fixed"))


def dep_auprc(pairs: DataFrame, threshold: float = 1.0, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Average precision by sample: equal scores are one step."""
    steps = _ranked_samples(pairs, threshold, keys).groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("k"), F.max("n_pos").alias("n_pos"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumns({"tp": F.sum("pos").over(w), "at": F.sum("k").over(w)})
    return curve.groupBy(*keys).agg(F.sum(F.col("pos") / F.col("n_pos") * F.col("tp") / F.col("at")).alias("auprc"))


def dep_metrics(pairs: DataFrame, threshold: float = 1.0, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """dep_counts() with recall_at_k of dep_rank() and auprc of dep_auprc() beside them (null where those have no row):
    all from one sort of a sample's cells, equal scores being one step."""
    both = pairs.where("t IS NOT NULL AND p IS NOT NULL").select(*keys, "feature_idx", (F.abs("t") > threshold).cast("int").alias("y"), (F.abs("p") > threshold).cast("int").alias("yh"), F.abs("p").alias("score"))
    w = Window.partitionBy(*keys)
    placed = w.orderBy(F.desc("score"), "feature_idx")
    every, step = placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.orderBy(F.desc("score"))
    x = both.withColumns({"rk": F.row_number().over(placed), "n": F.count("*").over(every), "n_pos": F.sum("y").over(every)}).withColumns({"tp_": F.sum("y").over(step), "at": F.count("*").over(step)})
    n = lambda c: F.sum(c.cast("long"))
    y, yh, mixed = F.col("y"), F.col("yh"), (F.max("n_pos") > 0) & (F.max("n_pos") < F.max("n"))
    hits = F.sum(F.when(F.col("rk") <= F.col("n_pos"), y).otherwise(0)) / F.max("n_pos")
    area = F.sum(F.when(y > 0, F.col("tp_") / F.col("at") / F.col("n_pos")))
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), n(y).alias("n_pos"), n(y * yh).alias("tp"), n((1 - y) * yh).alias("fp"), n(y * (1 - yh)).alias("fn"), F.when(mixed, hits).alias("recall_at_k"), F.when(mixed, area).alias("auprc")).where(F.col("n") >= MIN_N)
    return g.withColumns(_ratios())


def convention_table(spark) -> DataFrame:
    rows = [(c, m, MODULE_SPLITS[m], MODULE_WEIGHTS[m], k, w) for c, ms in CONVENTIONS.items() for m, ks in ms.items() for k, w in ks.items()]
    return spark.createDataFrame(rows, "convention string, module string, split string, module_weight double, metric string, weight double")


def assemble(metrics: DataFrame) -> DataFrame:
    """From (model, split, family, metric, value): module scores by convention, what is undefined or negative as 0.

    (convention, model, module, score, contribution). The convention table has a few dozen rows, hence its broadcast.
    """
    table = convention_table(metrics.sparkSession)
    models = metrics.select("model").distinct()
    want = models.join(F.broadcast(table))
    family = F.when(F.col("module") == "m1_abundance", "y").when(F.col("module") == "m4_dep", "dep").otherwise("delta")
    got = want.withColumn("family", family).join(metrics, ["model", "split", "family", "metric"], "left")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("value", F.lit(0.0))))
    by_module = got.groupBy("convention", "model", "module").agg(F.sum(clipped * F.col("weight")).alias("score"), F.max("module_weight").alias("mw"))
    return by_module.select("convention", "model", "module", "score", (F.col("score") * F.col("mw")).alias("contribution"))
