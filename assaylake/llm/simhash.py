"""Near duplicates by SimHash: BK-trees over fingerprints that share blocks, connected groups of what they find.

Semantics. null text: the empty text. A text of fewer words than a shingle is one shingle; one without words has
fingerprint zero, which links like any other. Texts of any length are taken whole. Every input row gives one output
row, repeated ids included; a null id names a component only where no other id does. Other columns keep their values
where rows are kept whole. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.components import connected_components
from assaylake.functions.scratch import drop, written

SEED = 42


def simhash(raw: bytes, shingle: int) -> int:
    """64 bits, each 1 where it is set in over half of the XXH64 hashes of the shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, SEED)
    width = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(width + 1) - 1
    starts = ends - width
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        a, b = starts[at : min(n, at + (1 << 16))].tolist(), ends[at + shingle - 1 : min(n, at + (1 << 16)) + shingle - 1].tolist()
        h = np.array([digest(text[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> np.uint64:
    """64 bits, each 1 where it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        raw = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        values, children, at = self.values, self.children, 0
        values.append(x)
        children.append({})
        if len(values) == 1:
            return
        while True:
            d = (values[at] ^ x).bit_count()
            nearer = children[at].get(d)
            if nearer is None:
                children[at][d] = len(values) - 1
                return
            at = nearer

    def within(self, x: int, radius: int) -> list[int]:
        """Places of the values at most `radius` away; only edges whose key can hold one are followed."""
        if not self.values:
            return []
        values, children, found, stack = self.values, self.children, [], [0]
        while stack:
            at = stack.pop()
            d = (values[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            for k, child in children[at].items():
                if -radius <= k - d <= radius:
                    stack.append(child)
        return found


def _stars(tree_values: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within the radius: each value with its group's root, not all pairs.

    With no probes of their own the tree's values probe it as it grows.
    """
    tree, known = BKTree(), list(tree_values)
    up = list(range(len(known) + len(probes or ())))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(i: int, found: list[int]) -> None:
        for j in found:
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)

    for i, x in enumerate(tree_values):
        if probes is None:
            join(i, tree.within(x, radius))
        tree.add(x)
    for i, x in enumerate(probes or (), len(tree_values)):
        known.append(x)
        join(i, tree.within(x, radius))
    return [(known[r], known[i]) for i in range(len(known)) if (r := root(i)) != i]


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of blocks - radius blocks of the 64 bits: two fingerprints within the radius agree under one at least."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 3, blocks: int = 5, tree_values: int = 4096) -> DataFrame:
    """(u, v) over distinct fingerprints `fp`, enough to connect all that are within the radius.

    Fingerprints meet where they agree on blocks. A meeting place of more than `tree_values` is cut into shards of
    about that many, and every pair of shards is a task of its own: the tree of the one, probed with the other. So
    memory has a bound, nothing is broadcast whole, and no link is lost, however large a group is.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(radius, blocks)])
    met = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("mask", "bits")).select("fp", F.xxhash64("mask", "bits").alias("key"))
    large = met.groupBy("key").count().where(F.col("count") > tree_values).select("key", F.ceil(F.col("count") / tree_values).cast("int").alias("shards"))
    dealt = met.join(large, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("shards")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    tasks = dealt.select("key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("probe"), (F.col("own") > F.col("other")).cast("int").alias("probing"), "fp")

    def run(batches):
        held = np.zeros((5, 0), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, rows.shape[1])
            several = ends - starts > 1
            for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                fps = rows[4, a:b].view(np.uint64).tolist()
                split = int(np.searchsorted(rows[3, a:b], 1))
                out += _stars(fps[:split], None if rows[1, a] == rows[2, a] else fps[split:], radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for b in batches:
            rows = np.hstack([held, np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])])
            if not rows.shape[1]:
                continue
            whole = int(np.flatnonzero((rows[:3] != rows[:3, -1:]).any(0))[-1]) + 1 if (rows[:3] != rows[:3, -1:]).any() else 0
            if whole:
                yield found(np.ascontiguousarray(rows[:, :whole]))
            held = rows[:, whole:]
        if held.shape[1]:
            yield found(np.ascontiguousarray(held))

    return tasks.repartition("key", "tree", "probe").sortWithinPartitions("key", "tree", "probe", "probing", "fp").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row per input row; component_id is the smallest doc_id reachable over links."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    joined = connected_components(links(distinct, radius, blocks))
    named = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = written(named, "rooted-fingerprints")
    lowest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    labels = written(named.join(lowest, "root").select("fp", "component_id"), "labelled-fingerprints")
    drop(distinct)
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """The rows of `docs` that stay: of each group the row with the smallest doc_id, all its columns as they were.

    Of rows that repeat both that id and the fingerprint one stays.
    """
    columns = docs.columns
    found = near_groups(docs, shingle, radius, blocks)
    lost = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp").distinct(), "near-copies")
    again = written(found.groupBy("doc_id", "fp").count().where("count > 1").select("doc_id", "fp"), "repeated-rows")
    if lost.isEmpty() and again.isEmpty():
        return docs
    unique_ids = lost.groupBy("doc_id").count().join(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count(), ["doc_id", "count"], "left_anti").isEmpty()
    if unique_ids and again.isEmpty():  # an id stands for one row, as it should
        return docs.join(lost.select("doc_id"), "doc_id", "left_anti").select(columns)
    prints = _with_fingerprint(docs, shingle)
    left = prints.join(lost.withColumnRenamed("doc_id", "__id").withColumnRenamed("fp", "__lost"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__lost")), "left_anti")
    return left.dropDuplicates(["doc_id", "__fp"]).select(columns)


def _with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(batches):
        for b in batches:
            fp = np.array([simhash(x, shingle) for x in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], [*b.schema.names[:-1], "__fp"])

    return docs.select("*", F.coalesce("text", F.lit("")).cast("binary").alias("__raw")).mapInArrow(run, schema + ", __fp long")
