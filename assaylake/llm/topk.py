"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors are cut into slices of dimensions that lie apart; a slice's part of a score is a local score. Phase one gathers
each slice's local top lists and asks all slices for what is on them: the k-th best total is a bound. If every local score
of a vector is below bound / slices, its score is below the bound, so phase two collects from each slice what reaches that
cutoff, with its local score. Phase three asks a slice only for the pairs that another one sent and it did not; what
reaches the bound is ranked.

Semantics. Components become floor(scale * x), scores are integers (held to the range of a long). Vectors that are
null, empty, or hold null or non-finite components take no part, nor do those of another length than the queries'.
A query's own row, that is its id, is no candidate; ids that repeat with different vectors are rows of their own
and, as queries, one query for each different vector. Ties go to the smaller id. Fewer candidates than k: all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions.scratch import drop, written

EXACT, LARGE = float(2**53), float(2**62)


def local_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers kept as doubles; exact whatever their size."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)))
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object)
    return whole(q) @ whole(x).T


def _as_long(v) -> int:
    return max(-(2**63), min(2**63 - 1, int(v)))


def usable(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of floor(scale * x), without rows that take no part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: _floor(x * scale)).alias("vector"))


def _floor(x: Column) -> Column:
    """Floor as a double: beyond 2**52 a double is whole already."""
    return F.when(F.abs(x) < float(2**52), F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, slices: int = 2, query_block: int = 2048, rows_per_task: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query.

    Equal vectors are one candidate with their k + 1 smallest ids, which is all that ties can need: a vector that
    fills a third of the table costs as much as any other. Queries go in blocks of about `query_block`, the only
    thing broadcast; each block is compared with all rows where these lie.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale, id_col, vector_col)
    rank = Window.partitionBy("vector").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    tasks = max(1, math.ceil(vectors.count() / rows_per_task))
    # ids may repeat with different vectors, so a vector has a name of its own
    table = written(distinct.select("ids", "vector").repartition(tasks).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    asked = usable(vectors.where(is_query), scale, id_col, vector_col).distinct()
    blocks = max(1, math.ceil(asked.count() / query_block))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")), "queries")
    done = []
    for i in range(blocks):
        block = asked.where(F.col("block") == i).select("id", "vector").toPandas().sort_values("id", kind="stable")  # of bounded size
        for width, part in block.groupby(block["vector"].map(len)):
            done.append(_block(spark, table, part["id"].to_numpy(), np.stack(part["vector"].to_list()), int(width), k, slices))
    drop(asked)
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _block(spark, table: DataFrame, ids: np.ndarray, q: np.ndarray, width: int, k: int, slices: int) -> DataFrame:
    same = table.where(F.size("vector") == width)
    largest = same.agg(F.max(F.array_max(F.transform("vector", F.abs)))).head()[0] or 0.0
    if float(np.abs(q).max(initial=0)) * largest * width >= LARGE:
        slices = 1  # sums of parts could leave a long: such vectors stay whole, and scores are held to its range
    cuts = [width * i // slices for i in range(slices + 1)]
    spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    m = len(spans)
    shared = spark.sparkContext.broadcast((ids, q))
    # a vector that has but one id is no candidate of the query of that id
    alone = F.struct(F.col("ids")[0].alias("first"), (F.size(F.array_distinct("ids")) == 1).alias("single"))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("slice"), F.slice("vector", a + 1, b - a).alias("part")) for i, (a, b) in enumerate(spans)]))
    apart = written(same.select("rep", alone.alias("alone"), each).repartition("slice", "rep"), "slices")

    def local(batch: pa.RecordBatch):
        """(slice, rows, local scores of all queries, whether a row is a candidate) for each slice in a batch."""
        which = batch.column(2).to_numpy()
        for s in np.unique(which).tolist():
            a, b = spans[s]
            rows = np.flatnonzero(which == s)
            part = local_scores(shared.value[1][:, a:b], _matrix(batch.column(3).take(pa.array(rows)), b - a))
            first, single = (c.to_numpy(zero_copy_only=False)[rows] for c in batch.column(1).flatten())
            yield s, rows, part, ~(single[None, :] & (shared.value[0][:, None] == first[None, :]))

    def sent(qi: np.ndarray, s: int, reps: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        held = np.array([_as_long(v) for v in scores.tolist()], np.int64) if scores.dtype == object or m == 1 else scores.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(qi.astype(np.int32)), pa.array(np.full(len(qi), s), pa.int32()), pa.array(reps, pa.int64()), pa.array(held)], ["q", "slice", "rep", "score"])

    def gather(batches):  # phase one: each slice's local lists
        for b in batches:
            for s, rows, part, ok in local(b):
                shown = np.where(ok, part.astype(float), -np.inf)
                top = np.argpartition(-shown, min(k, len(rows)) - 1, axis=1)[:, :k]
                qi, at = np.repeat(np.arange(len(part)), top.shape[1]), top.ravel()
                good = ok[qi, at]
                qi, at = qi[good], at[good]
                yield sent(qi, s, b.column(0).to_numpy()[rows[at]], part[qi, at])

    schema = "q int, slice int, rep long, score long"
    columns = apart.select("rep", "alone", "slice", "part")
    lists = columns.mapInArrow(gather, schema)
    order = Window.partitionBy("q", "slice").orderBy(F.desc("score"), "rep")
    listed = lists.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "rep").distinct()

    def asked(batches):
        for b in batches:
            for s, rows in ((s, np.flatnonzero(b.column(2).to_numpy() == s)) for s in range(m)):
                if len(rows):
                    lo, hi = spans[s]
                    x, own = _matrix(b.column(3).take(pa.array(rows)), hi - lo), shared.value[1][:, lo:hi]
                    qi = b.column(1).to_numpy()[rows]
                    large = np.abs(own).max(initial=0) * np.abs(x).max(initial=0) * (hi - lo) >= EXACT
                    scores = np.array([sum(int(u) * int(v) for u, v in zip(own[i], r, strict=True)) for i, r in zip(qi, x, strict=True)], object) if large else np.einsum("ij,ij->i", own[qi], x)
                    yield sent(qi, s, b.column(0).to_numpy()[rows], scores)

    def local_of(pairs: DataFrame, *keys: str) -> DataFrame:
        """The local scores of pairs (q, rep[, slice]) from the slices that are asked for."""
        return apart.join(pairs, list(keys)).select("rep", "q", "slice", "part").mapInArrow(asked, schema)

    totals = local_of(listed, "rep").groupBy("q", "rep").agg(F.sum("score").alias("score"))
    bound = Window.partitionBy("q").orderBy(F.desc("score"))  # of the lists, at most k a slice
    cut = totals.withColumn("n", F.row_number().over(bound)).where(F.col("n") == k).select("q", "score").toPandas()
    least = np.full(len(ids), -(2**63), np.int64)  # fewer than k candidates: everything is collected
    least[cut["q"].to_numpy(int)] = cut["score"].to_numpy(np.int64)
    safe = spark.sparkContext.broadcast(least)

    def collect(batches):  # phase two: each slice's entries that reach its share of the cutoff
        cutoff = np.where(safe.value == -(2**63), -np.inf, np.nextafter(safe.value / m, -np.inf))[:, None]
        for b in batches:
            for s, rows, part, ok in local(b):
                qi, at = np.nonzero((part.astype(float) >= cutoff) & ok)
                yield sent(qi, s, b.column(0).to_numpy()[rows[at]], part[qi, at])

    known = columns.mapInArrow(collect, schema).groupBy("q", "rep").agg(F.sum("score").alias("score"), F.collect_set("slice").alias("has"))
    known = written(known, "collected")
    # phase three: a slice that sent nothing is asked for what could still reach the bound
    missing = known.where(F.size("has") < m).select("q", "rep", F.explode(F.array_except(F.array(*[F.lit(s) for s in range(m)]), "has")).alias("slice"))
    rest = local_of(missing, "slice", "rep")
    bounds = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64()), "least": pa.array(least)}))
    whole = known.select("q", "rep", "score").unionByName(rest.select("q", "rep", "score")).groupBy("q", "rep").agg(F.sum("score").alias("score"))
    whole = whole.join(F.broadcast(bounds), "q").where("score >= least")  # a row for each query of the block
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = whole.join(same.select("rep", "ids"), "rep").select("q", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
