"""Profiling and quality control of metadata and measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.model import by_level, level_key
from assaylake.operators.ranks import percentiles, value_ranks


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, n_unique): one pass over the data, the rest on distinct values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])))
    counts = long.groupBy("column", "level").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.count("level").alias("n_unique"))


def column_levels(df: DataFrame, columns: list[str], few: int = 60, top: int = 20) -> DataFrame:
    """Counts of every level of columns with at most `few` of them, else of the `top` most frequent."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]))).where("level IS NOT NULL")
    counts = long.groupBy("column", "level").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rk", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "level"))).withColumn("levels", F.count("*").over(Window.partitionBy("column")))
    return ranked.where((F.col("levels") <= few) | (F.col("rk") <= top)).select("column", "level", "n")


def key_checks(df: DataFrame, key: str, by: str) -> DataFrame:
    """Rows, distinct keys, duplicates by group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_unique")).withColumn("n_duplicates", F.col("n") - F.col("n_unique"))


def crosstab(df: DataFrame, row: str, column: str, levels: list[str]) -> DataFrame:
    """Counts with zero fill; the column's levels are given, so no pass is spent on finding them."""
    return df.groupBy(row).pivot(column, levels).agg(F.count(F.lit(1))).na.fill(0, levels)


def entity_visibility(df: DataFrame, entity: str) -> DataFrame:
    """Entities by where they are seen: in train rows, only in test, shared by cohorts."""
    return df.groupBy(entity).agg(F.max((F.col("split") == "train").cast("int")).alias("in_train"), F.max((F.col("cohort") == "test").cast("int")).alias("in_test"), F.max((F.col("cohort") != "test").cast("int")).alias("in_train_val"))


def split_novelty(df: DataFrame) -> DataFrame:
    """By split: samples, strains and compounds, and how many of these no train row has."""
    train = df.where("split = 'train'")
    out = df.join(train.select("strain").distinct().withColumn("s_seen", F.lit(1)), "strain", "left").join(train.select("compound").distinct().withColumn("c_seen", F.lit(1)), "compound", "left")
    return out.groupBy("split").agg(
        F.count("*").alias("n_samples"), F.countDistinct("strain").alias("n_strains"), F.countDistinct(F.when(F.col("s_seen").isNull(), F.col("strain"))).alias("novel_strains"),
        F.countDistinct("compound").alias("n_compounds"), F.countDistinct(F.when(F.col("c_seen").isNull(), F.col("compound"))).alias("novel_compounds"),
    )


def functional_dependency(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys and how many values each has; the dependency holds where n_values is 1."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("n_values"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("vals"))


def control_availability(samples: DataFrame, levels: list[list[str]]) -> DataFrame:
    """By level, each for itself: the share of treated samples whose key has a control."""
    keys = samples.where("role = 'control'").select(F.inline(by_level(levels))).distinct().withColumn("hit", F.lit(1))
    return samples.where("role = 'treatment'").select(F.inline(by_level(levels))).join(keys, ["level", "key"], "left").groupBy("level").agg(F.count("*").alias("n_treated"), F.count("hit").alias("n_with_control"), F.avg(F.when(F.col("hit").isNull(), 0.0).otherwise(1.0)).alias("share"))


def match_cascade(matched: DataFrame, treated: DataFrame, n_levels: int) -> DataFrame:
    """Newly matched, cumulative and unmatched by level; levels are few, so the running sum is over a few rows."""
    total = treated.agg(F.count("*").alias("total"))
    levels = treated.sparkSession.range(1, n_levels + 1).select(F.col("id").cast("int").alias("level"))
    counts = levels.join(matched.groupBy("level").agg(F.count("*").alias("newly")), "level", "left").na.fill(0, ["newly"])
    running = F.sum("newly").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("cumulative", running).join(F.broadcast(total)).select("level", "newly", "cumulative", (F.col("total") - F.col("cumulative")).alias("unmatched"))


def fell_through(treated: DataFrame, matched: DataFrame, keys: list[str], top: int = 12) -> DataFrame:
    """The most frequent contexts among samples that no control of the finest level matched."""
    lost = treated.join(matched.where("level > 1").select("sample_id"), "sample_id", "left_semi")
    return lost.groupBy(level_key(keys).alias("context")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context").limit(top)


def group_composition(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vehicle sets of control groups and how often, replicate numbers and how often)."""
    groups = samples.where("role = 'control'").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("compound")), "+").alias("vehicles"), F.count("*").alias("replicates"))
    return groups.groupBy("vehicles").agg(F.count("*").alias("n_groups"), F.median("replicates").alias("median_replicates"), F.min("replicates").alias("min_replicates"), F.max("replicates").alias("max_replicates")), groups.groupBy("replicates").agg(F.count("*").alias("n_groups"))


def value_probe(cells: DataFrame, n_possible: DataFrame) -> DataFrame:
    """One row: how many cells are missing, zero or negative, percentiles, and whether the scale looks like logs."""
    x = value_ranks(cells, "value")  # zeros are one row of it
    v, n = F.col("value"), F.col("n")
    count = lambda c: F.sum(F.when(c, n).otherwise(0))
    totals = x.agg(F.sum("n").alias("n_present"), count(v == 0).alias("n_zero"), count(v < 0).alias("n_negative"), F.max(F.when(v != 0, v)).alias("hi"))
    q = percentiles(value_ranks(x.where("value <> 0"), "value", times="n"), "value", [0.01, 0.5, 0.99])
    out = totals.join(F.broadcast(q.select("q"))).join(F.broadcast(n_possible))
    return out.select((F.col("n_possible") - F.col("n_present")).alias("n_missing"), "n_zero", "n_negative", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99"), ((F.col("hi") < 64) & (F.col("n_negative") == 0)).alias("looks_log"))


def detection_rates(cells: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """(cohort, feature_id, detected, n, rate): what was never detected has no cells, so the dimensions count."""
    sizes = samples.groupBy("cohort").agg(F.count("*").alias("n"))
    seen = cells.where("value IS NOT NULL").join(samples.select("sample_id", "cohort"), "sample_id").groupBy("cohort", "feature_id").agg(F.count("*").alias("detected"))
    grid = sizes.join(F.broadcast(features.select("feature_id")))
    return grid.join(seen, ["cohort", "feature_id"], "left").na.fill(0, ["detected"]).withColumn("rate", F.col("detected") / F.col("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
