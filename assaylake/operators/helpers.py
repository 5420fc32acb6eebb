"""Small vectorised helpers on vectors of per-sample values, and MLlib fits on the dense matrix."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written
from assaylake.operators.factor import packed_sum


#: Cumulative probabilities of a Poisson(1) count, from 0 on.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def drawn(unit: str, reps: int, seed: int = 42) -> np.ndarray:
    """Poisson(1) counts of a unit for each repetition, from the hash of both: the same wherever a row lies and however
    often it is asked."""
    tail = f":{unit}".encode()
    heads = b"".join(hashlib.md5(b"%d:%d%b" % (seed, rep, tail)).digest()[:4] for rep in range(reps))
    return np.searchsorted(POISSON, np.frombuffer(heads, ">u4") / 2.0**32, side="right").astype(float)


def bootstrap_means(known: DataFrame, whole: DataFrame, *keys: str, reps: int = 1000) -> DataFrame:
    """(keys, rep_, m): the mean of `value` of the values that each repetition draws, for each of the keys in `whole`.

    Every sample is drawn a Poisson number of times in each repetition, so sums of a repetition are partial sums of
    whatever rows a task has, which it adds up in NumPy and sends once; only as many numbers as there are repetitions
    come together for a key. Samples of one id are drawn alike under every key, as paired comparisons need, and once for all.
    """
    names = [tuple(r[k] for k in keys) for r in whole.select(*keys).orderBy(*keys).collect()]  # a few, as they are groups to report
    number = {x: i for i, x in enumerate(names)}
    values = known.groupBy("sample_id").agg(F.collect_list(F.struct(*keys, "value")).alias("of"))
    columns = [F.col("sample_id").cast("string"), *[F.col(f"of.{k}").alias(k) for k in keys], F.col("of.value").alias("value")]

    def sums(batches):
        """A task's sums of weights, and of weights times values, by key and repetition."""
        total = np.zeros((len(names), reps, 2))
        for b in batches:
            unit, *lists = b.columns
            at = [number[x] for x in zip(*(c.flatten().to_pylist() for c in lists[:-1]), strict=True)]
            v, ends = lists[-1].flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(lists[-1]).to_pylist()])
            for i, x in enumerate(unit.to_pylist()):
                w = drawn(x, reps)
                for j in range(ends[i], ends[i + 1]):
                    total[at[j], :, 0] += w
                    total[at[j], :, 1] += w * v[j]
        key, rep = np.nonzero(total[..., 0])
        arrays = [pa.array(key.astype(np.int32)), pa.array(rep.astype(np.int32)), pa.array(total[key, rep, 0]), pa.array(total[key, rep, 1])]
        yield pa.RecordBatch.from_arrays(arrays, ["place_", "rep_", "w", "wv"])

    parts = values.select(*columns).mapInArrow(sums, "place_ int, rep_ int, w double, wv double")
    means = parts.groupBy("place_", "rep_").agg((F.sum("wv") / F.sum("w")).alias("m"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keys).schema)
    numbered = whole.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(names)], f"place_ int, {kinds}")
    return means.join(F.broadcast(numbered), "place_").drop("place_")


def interval(c: str) -> list[Column]:
    """lo and hi: the middle 95 % of what repetitions gave."""
    return [F.percentile(c, F.lit(0.025)).alias("lo"), F.percentile(c, F.lit(0.975)).alias("hi")]


def bootstrap_ci(per_sample: DataFrame, *keys: str, reps: int = 1000) -> DataFrame:
    """(keys, n, mean, lo, hi) of the mean of `value` by (keys, sample_id); intervals are NULL below three values."""
    known = written(per_sample.where("value IS NOT NULL").select(*keys, "sample_id", "value"), "bootstrap-values")
    whole = written(known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "bootstrap-means")
    ends = bootstrap_means(known, whole, *keys, reps=reps).groupBy(*keys).agg(*interval("m"))
    enough = lambda c: F.when(F.col("n") >= 3, F.col(c)).alias(c)
    return whole.join(ends, list(keys)).select(*keys, "n", "mean", enough("lo"), enough("hi"))


def margin_bootstrap(per_sample: DataFrame, terms: DataFrame, first: str, second: str, reps: int = 1000) -> DataFrame:
    """What one model is ahead of another in a weighted sum of terms: a row for each term and one for their sum.

    per_sample: (model, term, sample_id, value); terms: (term, split, weight), a few rows. A term of a model is the mean of the
    values it has among its samples, cut to between 0 and 1 and weighted; where it has none it counts 0. In each repetition the samples
    are drawn once, for both models and all terms.
    """
    spark = terms.sparkSession
    known = written(per_sample.where(F.col("value").isNotNull() & F.col("model").isin(first, second)).select("model", "term", "sample_id", "value"), "bootstrap-values")
    whole = written(known.groupBy("model", "term").agg(F.avg("value").alias("m")), "bootstrap-means")
    counts = known.groupBy("term").agg(F.countDistinct("sample_id").alias("n"))
    drawn_means = written(bootstrap_means(known, whole, "model", "term", reps=reps), "bootstrap-repetitions")
    # the point itself is a repetition of no number; terms that no sample has are there in every one
    every = spark.range(-1, reps).select(F.nullif(F.col("id").cast("int"), F.lit(-1)).alias("rep")).crossJoin(F.broadcast(terms))
    both = drawn_means.select("model", "term", F.col("rep_").alias("rep"), "m").unionByName(whole.select("model", "term", F.lit(None).cast("int").alias("rep"), "m"))
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("m")))
    both = both.groupBy("term", "rep").agg(of(first).alias("a"), of(second).alias("b"))
    met = every.join(both.withColumnRenamed("term", "term_").withColumnRenamed("rep", "rep_"), (F.col("term") == F.col("term_")) & F.col("rep").eqNullSafe(F.col("rep_")), "left")
    part = lambda c: F.col("weight") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    each = met.select("term", "split", "weight", "rep", part("a").alias("a"), part("b").alias("b"))
    total = each.groupBy("rep").agg(F.lit("margin").alias("term"), F.lit("all").alias("split"), F.sum("weight").alias("weight"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    x = each.unionByName(total).withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    point = lambda c: F.max(F.when(F.col("rep").isNull(), F.col(c)))
    d = F.when(F.col("rep").isNotNull(), F.col("d"))
    ends = {f"{c}{e}": F.percentile(F.when(F.col("rep").isNotNull(), F.col(c)), F.lit(q)) for c in "abd" for e, q in (("_lo", 0.025), ("_hi", 0.975))}
    out = x.groupBy("term", "split").agg(F.max("weight").alias("weight"), *[point(c).alias(c) for c in "abd"], F.avg(d).alias("d_mean"), F.stddev_samp(d).alias("d_sd"), F.avg((d > 0).cast("int")).alias("ahead"), *[v.alias(k) for k, v in ends.items()])
    sized = counts.unionByName(known.agg(F.lit("margin").alias("term"), F.countDistinct("sample_id").alias("n")))
    return out.join(sized, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gram(vectors: DataFrame, array_col: str) -> DataFrame:
    """(a, b, s, n): for each pair of places a, b the sum of products over all rows, n the rows; nulls count as 0.

    A partition adds up its own matrix and sends it by rows; those of one place are added up as they come.
    """

    def add_up(batches):
        total, n = None, 0
        for batch in batches:
            x = np.array([[0.0 if v is None else v for v in r] for r in batch.column(0).to_pylist()], float)
            if len(x):
                total, n = x.T @ x if total is None else total + x.T @ x, n + len(x)
        if total is not None:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], ["a", "n", "data"])

    def by_pair(batches):
        for batch in batches:
            for a, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(data, float)
                k = len(s)
                yield pa.RecordBatch.from_arrays([pa.array([a] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(s), pa.array([n] * k, pa.int64())], ["a", "b", "s", "n"])

    rows = vectors.where(F.col(array_col).isNotNull()).select(F.col(array_col).cast("array<double>"))
    return packed_sum(rows.mapInArrow(add_up, "a int, n long, data binary"), "a").mapInArrow(by_pair, "a int, b int, s double, n long")


def pca(dense: DataFrame, fit: DataFrame, k: int = 10) -> tuple[DataFrame, list[float]]:
    """(sample, component, score) and explained shares: centred on the fit mean, signs by the largest loading."""
    means = fit.groupBy("feature").agg(F.avg("value").alias("m"))
    centred = dense.join(F.broadcast(means), "feature").select("sample", "feature", (F.col("value") - F.col("m")).alias("v"))
    vectors = centred.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "v"))), lambda x: x["v"]).alias("a")).withColumn("features", array_to_vector("a"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors.join(fit.select("sample").distinct(), "sample", "left_semi"))
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, j]).argmax(), j])) for j in range(k)]
    scores = model.transform(vectors).select("sample", F.posexplode(vector_to_array("pc")).alias("component", "score"))
    return scores.withColumn("score", F.col("score") * F.element_at(F.array(*[F.lit(x) for x in signs]), F.col("component") + 1)), list(model.explainedVariance)
