"""Control matching through levels of context, Delta and what is measured on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.model import CONTROL_LEVELS, by_level


def exploded(samples: DataFrame, levels: list[list[str]], *keep: str) -> DataFrame:
    """sample_id, level, key (and `keep`) for every level of the hierarchy: as large as the metadata times levels."""
    return samples.select("sample_id", *keep, F.inline(by_level(levels)))


def match(treated: DataFrame, pool: DataFrame, levels: list[list[str]] = CONTROL_LEVELS) -> DataFrame:
    """(sample_id, level, key): the finest level at which the pool has at least one sample of the same key."""
    keys = exploded(pool, levels).select("level", "key").distinct()
    return exploded(treated, levels).join(keys, ["level", "key"]).groupBy("sample_id").agg(F.min("level").alias("level"), F.min_by("key", "level").alias("key"))


def control_index(cells: DataFrame, pool: DataFrame, levels: list[list[str]] = CONTROL_LEVELS, used: DataFrame | None = None, agg=F.median) -> DataFrame:
    """(level, key, feature_id, control, n_controls). With `used` (level, key) only those profiles are made, which
    keeps the coarse levels, the ones that hold every control, out of the shuffle unless somebody fell through."""
    at = exploded(pool, levels)
    if used is not None:
        at = at.join(used.select("level", "key").distinct(), ["level", "key"], "left_semi")
    return at.join(cells.select("sample_id", "feature_id", "value"), "sample_id").groupBy("level", "key", "feature_id").agg(agg("value").alias("control"), F.count("value").alias("n_controls"))


def delta(cells: DataFrame, samples: DataFrame, levels: list[list[str]] = CONTROL_LEVELS, pool: DataFrame | None = None, agg=F.median) -> DataFrame:
    """(sample_id, feature_id, value, control, y, level) of treated samples: y minus the matched control profile.

    No deeper level is tried for a cell whose matched controls did not detect the feature.
    """
    pool = samples.where("role = 'control'") if pool is None else pool
    matched = match(samples.where("role = 'treatment'"), pool, levels)
    index = control_index(cells, pool, levels, matched, agg)
    return cells.join(matched, "sample_id").join(index, ["level", "key", "feature_id"]).select("sample_id", "feature_id", (F.col("value") - F.col("control")).alias("value"), "control", F.col("value").alias("y"), "level")


def anchor(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, feature_id, control): the matched profile itself, whether or not the sample detected the feature."""
    pool = samples.where("role = 'control'")
    matched = match(samples.where("role = 'treatment'"), pool)
    return matched.join(control_index(cells, pool, used=matched), ["level", "key"]).select("sample_id", "feature_id", "control")
