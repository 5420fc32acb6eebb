"""Exact duplicates by Patricia tries of whole byte strings.

Semantics. null text: the empty text. Texts are equal when their UTF-8 bytes are. Of equal texts one row is the
owner, that with the largest (or smallest) id; a null id owns only where every id is null. Rows that repeat both id
and text cannot be told apart and share the owner's `kept`. Texts of any length are taken whole. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written

NODE_BYTES = 300  # what a node costs besides its label


class RadixTrie:
    """Compressed trie; a terminal holds [owner id, number of rows, payload]."""

    def __init__(self, prefer):
        self.prefer, self.root, self.cost = prefer, [b"", {}, None], 0

    def add(self, key: bytes, owner: int | None, rows: int, payload: str) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [owner, rows, payload]]
                self.cost += len(key) - at + NODE_BYTES
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k, most = 1, min(len(label), len(key) - at)  # the first byte agrees
            step = 1 << max(0, most.bit_length() - 1)
            while step:  # longest shared prefix by halving
                if k + step <= most and label[k : k + step] == key[at + k : at + k + step]:
                    k += step
                else:
                    step >>= 1
            fork = [label[:k], {label[k]: child} if k < len(label) else {}, None]
            child[0] = label[k:]
            node[1][key[at]] = fork
            self.cost += NODE_BYTES
            node, at = fork, at + k
        if node[2] is None:
            node[2] = [owner, rows, payload]
        else:
            own = node[2]
            own[0] = owner if own[0] is None else own[0] if owner is None else self.prefer(own[0], owner)
            own[1] += rows

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, list]]:
        """The terminals below the root's child `first` (or all, without it), which leave the trie."""
        if first is None:
            top, self.root, self.cost = (self.root, b""), [b"", {}, None], 0
        else:
            child = self.root[1].pop(first)
            top = (child, child[0])
        stack = [top]
        while stack:
            node, path = stack.pop()
            if first is not None:
                self.cost -= len(node[0]) + NODE_BYTES
            if node[2] is not None:
                yield path, node[2]
            stack.extend((c, path + c[0]) for c in node[1].values())


def _through_tries(keep: str, budget: int, with_text: bool):
    """mapInArrow function: rows of equal texts become one row. Beyond `budget` bytes the subtree of the last text
    spills downstream as partial results, which a later aggregate joins again: nothing is dropped."""
    names = ["n_bytes", "text_sha256", "owner", "copies"] + ["text"] * with_text

    def rows(found: list[tuple[bytes, list]]) -> pa.RecordBatch:
        arrays = [pa.array([len(p) for p, _ in found], pa.int64()), pa.array([t[2] for _, t in found], pa.string()), pa.array([t[0] for _, t in found], pa.int64()), pa.array([t[1] for _, t in found], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays + [pa.array([p for p, _ in found], pa.binary())] * with_text, names)

    def batched(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        part, held = [], 0
        for x in found:
            part.append(x)
            held += len(x[0]) + 100
            if held > 8_000_000:
                yield rows(part)
                part, held = [], 0
        if part:
            yield rows(part)

    def run(batches):
        trie = RadixTrie(max if keep == "largest" else min)
        for b in batches:
            copies = b.column("copies").to_pylist()
            for text, sha, owner, n in zip(b.column("text"), b.column("text_sha256").to_pylist(), b.column("owner").to_pylist(), copies, strict=True):
                key = text.as_py()
                trie.add(key, owner, n, sha)
                if trie.cost > budget:
                    yield from batched(trie.take(key[0] if key else next(iter(trie.root[1]))))
        yield from batched(trie.take())

    return run


def exact_groups(docs: DataFrame, keep: str = "smallest", budget_bytes: int = 96_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per input row.

    Copies within a scan partition meet in a trie before anything is shuffled, so that a text that fills a third of
    the rows is shuffled once a task. The distinct texts are dealt out by length and content hash to tries that
    compare whole byte strings. Owners go back to the rows on (length, digest); that join's large side may be split.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("text_sha256"), raw.alias("text"))
    schema = "n_bytes long, text_sha256 string, owner long, copies long"
    local = rows.select("n_bytes", "text_sha256", F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("copies"), "text").mapInArrow(_through_tries(keep, budget_bytes, True), schema + ", text binary")
    resolved = local.repartition("n_bytes", "text_sha256").mapInArrow(_through_tries(keep, budget_bytes, False), schema)
    best = F.max if keep == "largest" else F.min
    owners = written(resolved.groupBy("n_bytes", "text_sha256").agg(best("owner").alias("keep_id"), F.sum("copies").alias("group_size")), "owners")
    return rows.drop("text").join(owners, ["n_bytes", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
