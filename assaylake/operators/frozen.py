"""Statistics frozen on train rows: profiles from the finest level with enough of them, and baseline predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written
from assaylake.model import by_level, level_key


def fit_rows(samples: DataFrame) -> DataFrame:
    return samples.where("split = 'train'")


def level_of(serve: DataFrame, fit: DataFrame, levels: list[list[str]], min_rows: int = 3) -> DataFrame:
    """(sample_id, level, key): the finest level whose group has at least `min_rows` fit rows; the last level always."""
    sizes = fit.select(F.inline(by_level(levels))).groupBy("level", "key").agg(F.count("*").alias("n")).where((F.col("n") >= min_rows) | (F.col("level") == len(levels)))
    at = serve.select("sample_id", F.inline(by_level(levels)))
    return at.join(sizes, ["level", "key"]).groupBy("sample_id").agg(F.min("level").alias("level"), F.min_by("key", "level").alias("key"), F.min_by("n", "level").alias("n_rows"))


def profiles(cells: DataFrame, fit: DataFrame, levels: list[list[str]], used: DataFrame | None = None) -> DataFrame:
    """(level, key, feature_id, mu): means over fit rows that detected the feature."""
    at = fit.select("sample_id", F.inline(by_level(levels)))
    if used is not None:
        at = at.join(used.select("level", "key").distinct(), ["level", "key"], "left_semi")
    return at.join(cells.select("sample_id", "feature_id", "value"), "sample_id").groupBy("level", "key", "feature_id").agg(F.avg("value").alias("mu"))


def hierarchical_mean(cells: DataFrame, samples: DataFrame, levels: list[list[str]], serve: DataFrame | None = None, fit: DataFrame | None = None, min_rows: int = 3) -> DataFrame:
    """(sample_id, feature_id, mu, level) for every served sample: a profile, with no deeper level for single cells."""
    fit = fit_rows(samples) if fit is None else fit
    chosen = level_of(samples if serve is None else serve, fit, levels, min_rows)
    return chosen.join(profiles(cells, fit, levels, chosen), ["level", "key"]).select("sample_id", "feature_id", "mu", "level")


def with_hierarchical_means(cells: DataFrame, source: DataFrame, samples: DataFrame, serve: DataFrame, hierarchies: dict[str, list[list[str]]], wanted: list[tuple[str, str, str]], min_rows: int = 3) -> DataFrame:
    """cells (sample_id, feature_id, ...) with a column for each (name, hierarchy, column of `source`) in `wanted`: means
    over fit rows at the finest level of the hierarchy with enough of them.

    Levels of all hierarchies are looked up together, and all profiles come from one aggregate; a sample's profile then
    joins by level, key and feature, so that none is written out for every sample.
    """
    names = list(hierarchies)
    at = F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(i).alias("level"), level_key(k).alias("key")) for h, levels in hierarchies.items() for i, k in enumerate(levels, 1)]))
    last = F.create_map(*[F.lit(x) for h, levels in hierarchies.items() for x in (h, len(levels))])[F.col("h")]
    fit = fit_rows(samples).select("sample_id", at)
    sizes = fit.groupBy("h", "level", "key").agg(F.count("*").alias("n")).where((F.col("n") >= min_rows) | (F.col("level") == last))
    chosen = serve.select("sample_id", at).join(sizes.select("h", "level", "key"), ["h", "level", "key"]).groupBy("sample_id", "h").agg(F.min("level").alias("level"), F.min_by("key", "level").alias("key"))
    chosen = written(chosen, "chosen-levels")
    columns = sorted({c for _, _, c in wanted})
    used = fit.join(chosen.select("h", "level", "key").distinct(), ["h", "level", "key"], "left_semi")
    means = written(used.join(source.select("sample_id", "feature_id", *columns), "sample_id").groupBy("h", "level", "key", "feature_id").agg(*[F.avg(c).alias(c) for c in columns]), "profiles")
    out = cells.join(chosen.groupBy("sample_id").pivot("h", names).agg(F.first(F.struct("level", "key"))), "sample_id", "left")
    for h in names:
        part = means.where(F.col("h") == h).select(F.struct("level", "key").alias(h), "feature_id", *[F.col(c).alias(name) for name, of, c in wanted if of == h])
        out = out.join(part, [h, "feature_id"], "left")
    return out.drop(*names)


def fallback_chain(grid: DataFrame, context: DataFrame, cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Context mean, else the feature's train mean, else the train median of everything."""
    train = cells.join(fit_rows(samples).select("sample_id"), "sample_id")
    by_feature = train.groupBy("feature_id").agg(F.avg("value").alias("fm"))
    overall = train.agg(F.median("value").alias("gm"))
    out = grid.join(context.select("sample_id", "feature_id", "mu"), ["sample_id", "feature_id"], "left").join(F.broadcast(by_feature), "feature_id", "left").join(F.broadcast(overall))
    return out.select("sample_id", "feature_id", F.coalesce("mu", "fm", "gm").alias("value"))
