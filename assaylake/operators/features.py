"""Feature engineering at the (sample, feature) grain: out-of-fold group means by subtraction, frozen scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.model import level_key
from assaylake.operators.ranks import value_ranks

MIN_CELLS = 3
UNSEEN = "__UNSEEN__"


def derived_columns(samples: DataFrame) -> DataFrame:
    """Numeric time and temperature, well row and column; what cannot be read is NULL and counted by the caller."""
    row = F.regexp_extract("well", "^([A-Ha-h])", 1)
    return samples.withColumns({
        "time_num": F.expr("try_cast(pert_time AS double)"), "temperature_num": F.expr("try_cast(temperature AS double)"),
        "well_row": F.when(row != "", F.ascii(F.upper(row)) - 64), "well_col": F.expr("try_cast(regexp_extract(well, '([0-9]+)$', 1) AS int)"),
    })


def group_mean(cells: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """(key, feature_id, mean, n) where at least three cells are there."""
    at = samples.select("sample_id", level_key(keys).alias("key"))
    return cells.join(at, "sample_id").groupBy("key", "feature_id").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).where(F.col("n") >= MIN_CELLS)


def folds(fit: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, fold): balanced, from the order of a seeded hash, counted over ranges of it."""
    order = fit.select(F.concat(F.md5(F.concat(F.lit("42:"), F.col("sample_id"))), F.col("sample_id")).alias("o"))
    return value_ranks(order, "o").select(F.substring("o", 33, 2**31 - 1).alias("sample_id"), (F.col("below") % k).cast("int").alias("fold"))


def oof_group_mean(cells: DataFrame, samples: DataFrame, fold_of: DataFrame, keys: list[str]) -> DataFrame:
    """(sample_id, feature_id, full, oof): group means with and without the sample's own fold.

    One aggregate by (key, feature, fold); a fold's share is subtracted from the total, so nothing is fitted k times.
    A sample outside the fit rows is served the full mean.
    """
    at = samples.join(fold_of, "sample_id", "left").select("sample_id", level_key(keys).alias("key"), F.coalesce("fold", F.lit(-1)).alias("fold"))
    part = cells.join(at.where("fold >= 0"), "sample_id").groupBy("key", "feature_id", "fold").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    total = part.groupBy("key", "feature_id").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    served = at.join(total, "key").join(part, ["key", "feature_id", "fold"], "left")
    n = F.col("tn") - F.coalesce("n", F.lit(0))
    return served.select("sample_id", "feature_id", F.when(F.col("tn") >= MIN_CELLS, F.col("ts") / F.col("tn")).alias("full"), F.when(n >= MIN_CELLS, (F.col("ts") - F.coalesce("s", F.lit(0.0))) / n).alias("oof"))


def vocabulary(df: DataFrame, fit: DataFrame, column: str) -> DataFrame:
    """Levels that the fit rows do not have become __UNSEEN__."""
    known = fit.select(column).distinct().withColumn("__known", F.lit(1))
    return df.join(known, column, "left").withColumn(column, F.when(F.col("__known").isNull(), UNSEEN).otherwise(F.col(column))).drop("__known")


def regime_mask(df: DataFrame, by_compound: list[str], by_strain: list[str]) -> DataFrame:
    """df (regime, compound, strain, ...) without what its regime cannot know: columns that depend on a novel entity are
    NULL, the entity is __UNSEEN__, and has_drug_prior and has_strain_prior say which was known."""
    out = df
    for entity, flag, columns, novel in (("compound", "has_drug_prior", by_compound, ["chem_novel", "both_novel"]), ("strain", "has_strain_prior", by_strain, ["strain_novel", "both_novel"])):
        seen = ~F.col("regime").isin(*novel)
        out = out.withColumns({flag: seen.cast("int"), entity: F.when(seen, F.col(entity)).otherwise(UNSEEN), **{c: F.when(seen, F.col(c)) for c in columns}})
    return out


def standardise(df: DataFrame, fit_condition: str, columns: list[str]) -> DataFrame:
    """z-scores by the fit rows' mean and sd (1 where that is tiny); gaps take the mean. The moments are one row."""
    stats = df.where(fit_condition).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    sd = lambda c: F.when(F.col(f"{c}_s") > 1e-6, F.col(f"{c}_s")).otherwise(1.0)
    out = df.join(F.broadcast(stats))
    return out.withColumns({c: (F.coalesce(F.col(c), F.col(f"{c}_m")) - F.col(f"{c}_m")) / sd(c) for c in columns}).select(df.columns)


def bit_filter(bits: DataFrame, fit: DataFrame, at_least: int = 2) -> DataFrame:
    """Bits set in at least two and in at most n - 2 of the fit entities. bits: (entity, bit)."""
    n = fit.select("entity").distinct().agg(F.count("*").alias("n"))
    return bits.join(fit.select("entity").distinct(), "entity", "left_semi").groupBy("bit").agg(F.countDistinct("entity").alias("k")).join(F.broadcast(n)).where((F.col("k") >= at_least) & (F.col("k") <= F.col("n") - at_least)).select("bit", "k")


def attach_block(df: DataFrame, block: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """df with the columns of its entities' block; an entity that the block does not know is an error, unless not
    `strict`: then its rows go, and the caller counts them."""
    if strict and not (lost := df.join(block, key, "left_anti").select(key).distinct().limit(5)).isEmpty():
        raise ValueError(f"not in the block: {', '.join(str(r[0]) for r in lost.collect())}")
    return df.join(block, key)
