"""Splits, folds, regimes and leakage audits; all on metadata-size tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def seeded(key: str | Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key) if isinstance(key, str) else key))


def leak_audit(samples: DataFrame) -> DataFrame:
    """By split other than train: ids shared with train, novel strains, compounds, cells (strain, compound) and conditions."""
    train = samples.where("split = 'train'")
    x = samples.where("split <> 'train'")
    for keys, name in ((["sample_id"], "id"), (["strain"], "strain"), (["compound"], "compound"), (["strain", "compound"], "pair"), (["strain", "compound", "medium", "temperature", "pert_time"], "condition")):
        x = x.join(train.select(*keys).distinct().withColumn(f"has_{name}", F.lit(1)), keys, "left")
    novel = lambda n: F.avg(F.col(f"has_{n}").isNull().cast("double"))
    return x.groupBy("split").agg(F.count("*").alias("n"), F.count("has_id").alias("shared_ids"), novel("strain").alias("novel_strain"), novel("compound").alias("novel_compound"), novel("pair").alias("novel_pair"), novel("condition").alias("novel_condition"))


def time_semantics(samples: DataFrame, split: str) -> DataFrame:
    """One row: of the time split's rows, how many train times their condition has and whether their time is new to it."""
    keys = ["strain", "compound", "medium", "temperature"]
    train = samples.where("split = 'train'")
    times = train.groupBy(*keys).agg(F.countDistinct("pert_time").alias("n_times"))
    seen = train.select(*keys, "pert_time").distinct().withColumn("seen", F.lit(1))
    x = samples.where(F.col("split") == split).join(times, keys, "left").join(seen, [*keys, "pert_time"], "left")
    return x.agg(F.count("*").alias("n"), F.avg("n_times").alias("mean_times"), F.min("n_times").alias("min_times"), F.count(F.when(F.col("n_times").isNotNull() & F.col("seen").isNull(), 1)).alias("unseen_times"), F.count(F.when(F.col("n_times").isNull(), 1)).alias("new_conditions"))


def inner_holdout(samples: DataFrame, entity: str = "compound", share: float = 0.25, at_least: int = 2) -> DataFrame:
    """(entity, held): a share of the train entities, those whose seeded hash is lowest."""
    e = samples.where("split = 'train' AND role = 'treatment'").select(entity).distinct()
    n = e.agg(F.greatest(F.lit(at_least), F.floor(F.count("*") * share)).alias("k"))
    return e.withColumn("rk", F.row_number().over(Window.orderBy(seeded(entity), entity))).join(F.broadcast(n)).select(entity, (F.col("rk") <= F.col("k")).alias("held"))


def route_regime(serve: DataFrame, fit: DataFrame) -> DataFrame:
    """full, chem_novel, strain_novel or both_novel, by what the fit rows have; entities are few."""
    x = serve.join(fit.select("compound").distinct().withColumn("hc", F.lit(1)), "compound", "left").join(fit.select("strain").distinct().withColumn("hs", F.lit(1)), "strain", "left")
    regime = F.when(F.col("hc").isNull() & F.col("hs").isNull(), "both_novel").when(F.col("hc").isNull(), "chem_novel").when(F.col("hs").isNull(), "strain_novel").otherwise("full")
    return x.withColumn("regime", regime).drop("hc", "hs")


def pack_groups(counts: list[tuple[str, int]], k: int) -> list[tuple[str, int]]:
    """Largest first into the least loaded group; over the entities of the design, a short list."""
    load, out = [0] * k, []
    for name, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        g = min(range(k), key=lambda i: (load[i], i))
        load[g] += n
        out.append((name, g))
    return out


def group_folds(samples: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(compound, fold) balanced by rows, (strain, fold) dealt in turn. Entities, not rows, reach the driver."""
    train = samples.where("split = 'train' AND role = 'treatment'")
    counts = [(r["compound"], r["count"]) for r in train.groupBy("compound").count().collect()]
    strains = sorted(r["strain"] for r in train.select("strain").distinct().collect())
    spark = samples.sparkSession
    return spark.createDataFrame(pack_groups(counts, k), "compound string, fold int"), spark.createDataFrame([(x, i % k) for i, x in enumerate(strains)], "strain string, fold int")


def fold_rows(samples: DataFrame, k: int = 5) -> DataFrame:
    """Every train row in every fold, as fit, or held out for its compound, its strain or both."""
    compounds, strains = group_folds(samples, k)
    train = samples.where("split = 'train' AND role = 'treatment'")
    x = train.join(F.broadcast(compounds.withColumnRenamed("fold", "cf")), "compound").join(F.broadcast(strains.withColumnRenamed("fold", "sf")), "strain")
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    c, st = F.col("cf") == F.col("fold"), F.col("sf") == F.col("fold")
    return x.withColumn("use", F.when(c & st, "both_novel").when(c, "chem_novel").when(st, "strain_novel").otherwise("fit")).select("sample_id", "strain", "compound", "fold", "use")


def fold_audit(folds: DataFrame) -> DataFrame:
    """By fold: rows by use, and held-out compounds or strains that a fit row of the fold still has."""
    fit = folds.where("use = 'fit'")
    x = folds.where("use <> 'fit'").join(fit.select("fold", "compound").distinct().withColumn("lc", F.lit(1)), ["fold", "compound"], "left").join(fit.select("fold", "strain").distinct().withColumn("ls", F.lit(1)), ["fold", "strain"], "left")
    leaks = x.groupBy("fold").agg(F.count("*").alias("n_dev"), F.count(F.when(F.col("use").isin("chem_novel", "both_novel") & F.col("lc").isNotNull(), 1)).alias("compound_leaks"), F.count(F.when(F.col("use").isin("strain_novel", "both_novel") & F.col("ls").isNotNull(), 1)).alias("strain_leaks"))
    return fit.groupBy("fold").agg(F.count("*").alias("n_fit")).join(leaks, "fold", "full")
