"""Correlations of all pairs of features over the samples that have both, in blocks of features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions.scratch import written
from assaylake.operators.factor import packed_sum
from assaylake.operators.ranks import value_ranks


def coresponse_knn(cells: DataFrame, k: int = 20, least: int = 20, block: int = 256, rows: int = 1024, deals: int = 8) -> DataFrame:
    """(src, dst, weight, n), src < dst: for each feature its k largest correlations, ties by name, cut at 0; an edge has
    the larger weight of both directions, those of 0 are none. cells: (sample_id, feature_id, value).

    Features are standardised over the samples that have them; a missing value counts as the mean, and a feature with
    fewer than `least` values correlates with none. n is the number of samples that have both.

    A tile holds the values of a block of features in a group of samples. Two tiles of one group meet and give a block
    of products; blocks of one pair are added up as they come, and leave only each feature's k best. No task holds more than a
    pair of tiles and one block, whatever the number of features.
    """
    known = cells.where("value IS NOT NULL").select("sample_id", "feature_id", "value")
    stats = known.groupBy("feature_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    axis = value_ranks(stats, "feature_id").select("feature_id", F.col("below").alias("at"))  # places by name, counted over ranges
    axis = written(stats.join(axis, "feature_id"), "feature-axis")
    z = (F.col("value") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    samples = known.select("sample_id").distinct()
    total = samples.count()
    groups = max(1, math.ceil(total / rows))
    dealt = samples.withColumn("grp", F.pmod(F.xxhash64("sample_id"), F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("row", F.row_number().over(Window.partitionBy("grp").orderBy("sample_id")) - 1)
    entry = F.struct(F.col("row"), (F.col("at") % block).cast("int").alias("place"), z.alias("z"))
    placed = known.join(axis.where(F.col("n") >= least), "feature_id").join(dealt, "sample_id")
    tiles = placed.groupBy("grp", F.floor(F.col("at") / block).cast("int").alias("block")).agg(F.collect_list(entry).alias("e"))  # rows * block at most
    tiles = written(tiles, "tiles")
    left, right = tiles.toDF("grp", "a", "ea"), tiles.toDF("grp", "b", "eb")
    pairs = left.join(right, "grp").where("a <= b").withColumn("deal", F.col("grp") % deals)
    pairs = pairs.select("a", "b", "deal", "ea", "eb").repartition("a", "b", "deal").sortWithinPartitions("a", "b", "deal")

    def tile(cells_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, place, value = (cells_.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        z_, has = np.zeros((row.max() + 1, block)), np.zeros((row.max() + 1, block))
        z_[row, place], has[row, place] = value, 1.0
        return z_, has

    def run(batches):
        now, total_ = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([1], pa.int64()), pa.array([total_.tobytes()], pa.binary())], ["a", "b", "n", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in range(3))
                (za, ha), (zb, hb) = tile(batch.column(3)[i]), tile(batch.column(4)[i])
                m = max(len(za), len(zb))
                pad = lambda x, m=m: np.pad(x, ((0, m - len(x)), (0, 0)))
                both = np.stack([pad(za).T @ pad(zb), pad(ha).T @ pad(hb)])
                if now is not None and key != now:
                    yield out()
                    total_ = None
                now, total_ = key, both if total_ is None else total_ + both
        if now is not None:
            yield out()

    sums = packed_sum(pairs.mapInArrow(run, "a int, b int, n long, data binary"), "a", "b")

    def best(batches):
        for batch in batches:
            for a, b, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, both = np.frombuffer(data, float).reshape(2, block, block)
                s = s / max(total - 1, 1)
                for first, second, w, n in ((a, b, s, both), (b, a, s.T, both.T))[: 1 + (a != b)]:
                    w = w.copy()
                    if first == second:
                        np.fill_diagonal(w, -np.inf)
                    order = np.argsort(-w, axis=1, kind="stable")[:, : k + 1]
                    i = np.repeat(np.arange(block), order.shape[1])
                    j = order.ravel()
                    keep = np.isfinite(w[i, j])
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(first * block + i, pa.int64()), pa.array(second * block + j, pa.int64()), pa.array(w[i, j]), pa.array(n[i, j].astype(np.int64))], ["src", "dst", "w", "n"])

    size = axis.count()
    found = sums.mapInArrow(best, "src long, dst long, w double, n long").where((F.col("src") < size) & (F.col("dst") < size))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))  # k candidates a block
    near = found.withColumn("rk", rank).where((F.col("rk") <= k) & (F.col("w") > 0))
    edges = near.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.max("w").alias("weight"), F.max("n").alias("n"))
    name = lambda c, to: axis.select(F.col("at").alias(c), F.col("feature_id").alias(to))
    return edges.join(name("i", "src"), "i").join(name("j", "dst"), "j").select("src", "dst", "weight", "n")
