"""Repeated passages across documents: confirmed by content-defined anchors, located by sharded Aho-Corasick automata.

A window is `window` consecutive words of one document (words are runs of anything but ASCII white space, unchanged).
A window repeats if its word sequence also starts in a row with a smaller doc_id.

Semantics. null text: no words. A null id counts as larger than every other. Rows that share an id do not remove
from one another. Texts of any length are taken whole; one of fewer words than a window keeps them all. Rows that
repeat id and text are cut alike, each staying a row. Other columns keep their values. Empty tables give empty results.

How. In every window the k-gram of smallest hash (the leftmost, in a tie) is its anchor; equal windows have equal
anchors at the same place, so only windows whose anchor occurs under two ids can repeat. Such an anchor's occurrence
and the windows it stands for make a segment. Segments meet by anchor, equal ones once; an automaton of the anchors'
phrases locates each of them in every segment, and the windows around are compared as whole texts.
"""

from __future__ import annotations

import bisect
import functools
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import drop, written

LAST = 2**63 - 1  # stands for a null id
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, _INVERSE, np.uint64))


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hash of each k consecutive words, from prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    up, down = _powers(1 << max(10, n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    g = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def anchors(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-gram, place of each window's anchor); no windows in too few words."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = gram_hashes(words, k)
    inside = window - k + 1
    n = len(g) - inside + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, 1 << 17):
        part = np.lib.stride_tricks.sliding_window_view(g[i : min(n, i + (1 << 17)) + inside - 1], inside)
        at[i : i + len(part)] = part.argmin(1) + np.arange(i, i + len(part))
    return g, at


def sliced(batches, rows: int = 512):
    """The same rows in smaller batches, so that a task holds few whole texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rank, th, raw): a row is known by its id, null last, and its text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))


_SEGMENT = "rank long, th long, start int, anchor long, seg1 long, seg2 long, anchor_at int, text string"


def _find_segments(window: int, k: int):
    """From rows with their recurring anchors: a row per occurrence of a segment, without text, and one with text per
    different segment of a slice of the input, with the smallest rank there."""
    names = [x.split()[0] for x in _SEGMENT.split(", ")]

    def run(batches):
        for b in sliced(batches, 2000):
            texts: dict[int, list] = {}
            rows: list[tuple] = []
            for part in sliced([b], 200):
                for rank, th, raw, known in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words = raw.split()
                    g, at = anchors(words, window, k)
                    if not len(at):
                        continue
                    cuts = np.flatnonzero(np.diff(at)) + 1
                    first, last = np.append(0, cuts), np.append(cuts, len(at))
                    keep = np.isin(g[at[first]], np.array(known, np.int64).view(np.uint64))
                    for i, j in zip(first[keep].tolist(), last[keep].tolist(), strict=True):
                        text = b" ".join(words[i : j - 1 + window])
                        digest = xxhash.xxh3_128_intdigest(text)
                        name = ((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63))
                        anchor = int(g[at[i]].view(np.int64))
                        if (seen := texts.get(digest)) is None:
                            texts[digest] = [rank, None, None, anchor, *name, int(at[i]) - i, text.decode()]
                        elif rank < seen[0]:
                            seen[0] = rank
                        rows.append((rank, th, i, anchor, *name, None, None))
                if len(rows) + len(texts) > 20_000:
                    yield _batch([*rows, *map(tuple, texts.values())], names, _SEGMENT)
                    rows, texts = [], {}
            yield _batch([*rows, *map(tuple, texts.values())], names, _SEGMENT)

    return run


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(columns, schema.split(", "), strict=True)], names)


_OWNED = "seg1 long, seg2 long, shift int, owners array<long>"


def _resolve(window: int, k: int, shard_segments: int):
    """From segments sorted by meeting place: the smallest id of each window, for segments where one may repeat.

    A shard is some whole meeting places, about `shard_segments` segments: one automaton of their anchors' phrases.
    """
    names = [x.split()[0] for x in _OWNED.split(", ")]

    def shard(segments: dict[tuple, list]) -> pa.RecordBatch:
        automaton = ahocorasick.Automaton()
        for anchor_at, _, text in segments.values():
            phrase = " " + " ".join(text.split(" ", anchor_at + k)[anchor_at : anchor_at + k]) + " "
            automaton.add_word(phrase, len(phrase) - 1)
        automaton.make_automaton()
        place: dict[bytes, int] = {}  # of each window's digest among the owners
        owner: list[int] = []
        located = []
        for (_, seg1, seg2, shift), (_, rank, text) in segments.items():
            edge = list(itertools.accumulate((len(w) + 1 for w in text.split(" ")), initial=0))
            n = len(edge) - window
            at_start = np.full(n, -1, np.int32)
            for end, size in automaton.iter(" " + text + " "):
                at = bisect.bisect_left(edge, end - size)  # the word after the phrase's first space
                for i in range(max(0, at + k - window), min(at, n - 1) + 1):
                    if at_start[i] < 0:
                        x = place.setdefault(xxhash.xxh3_128_digest(text[edge[i] : edge[i + window] - 1]), len(owner))
                        at_start[i] = x
                        if x == len(owner):
                            owner.append(rank)
                        elif rank < owner[x]:
                            owner[x] = rank
            located.append((seg1, seg2, shift, at_start))
        of = np.array([*owner, LAST], np.int64)
        return _batch([(s1, s2, shift, of[at].tolist()) for s1, s2, shift, at in located], names, _OWNED)

    def run(batches):
        held: dict[tuple, list] = {}
        last = None
        for b in sliced(batches, 2000):
            for spot, seg1, seg2, shift, anchor_at, rank, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= shard_segments and spot != last:
                    yield shard(held)
                    held = {}
                last = spot
                seen = held.setdefault((spot, seg1, seg2, shift), [anchor_at, rank, text])
                seen[1] = min(seen[1], rank)
        if held:
            yield shard(held)

    return run


def _together(windows: DataFrame, found: DataFrame) -> DataFrame:
    """(seg1, seg2, shift, owners): the owners of a segment's windows (seg1, seg2, shift, d1, d2), each once, in one row
    from shift 0, as other segments have them. `found` has each window's own (as seg1, seg2) and its one owner."""
    one = found.select(F.col("seg1").alias("d1"), F.col("seg2").alias("d2"), F.get("owners", F.lit(0)).alias("owner"))
    listed = windows.select("seg1", "seg2", "shift", "d1", "d2").join(one, ["d1", "d2"]).groupBy("seg1", "seg2").agg(F.array_sort(F.collect_list(F.struct("shift", "owner"))).alias("w"))
    return listed.select("seg1", "seg2", F.lit(0).alias("shift"), F.col("w.owner").alias("owners"))


def repeated_windows(docs: DataFrame, window: int = 50, k: int = 16, shard_segments: int = 1500, crowded: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, th, starts array<int>): where repeated windows start, for the rows that have some.

    Anchors are counted before they are shuffled and equal segments meet once, so copies cost no more than their
    number of anchors. A meeting place of more than `crowded` different segments is split: each of its windows goes
    to a place of its own text, equal ones aggregated to one with the smallest id before they are shuffled.
    """
    rows = _keyed(docs, id_col, text_col)
    marked = written(rows.select("rank", "th", "raw").mapInArrow(_anchors_of_rows(window, k), "rank long, th long, anchor long"), "anchors")
    recurring = marked.groupBy("anchor").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("anchor")
    per_row = marked.join(recurring, "anchor").groupBy("rank", "th").agg(F.collect_set("anchor").alias("known"))
    segments = written(rows.join(per_row, ["rank", "th"]).select("rank", "th", "raw", "known").mapInArrow(_find_segments(window, k), _SEGMENT), "segments")
    drop(marked)

    texts = segments.where("text IS NOT NULL").drop("th", "start")
    large = written(texts.groupBy("anchor").agg(F.approx_count_distinct("seg1").alias("n")).where(F.col("n") > crowded).select("anchor"), "crowded-anchors")
    calm = texts.select(F.xxhash64("anchor").alias("place"), "seg1", "seg2", F.lit(0).alias("shift"), "anchor_at", "rank", "text", "anchor")
    meeting = ["place", "seg1", "seg2", "shift", "anchor_at", "rank", "text"]

    def resolved(x: DataFrame) -> DataFrame:
        return x.select(meeting).repartition("place").sortWithinPartitions("place").mapInArrow(_resolve(window, k, shard_segments), _OWNED)

    crowd = None
    if large.isEmpty():
        owned = resolved(calm)
    else:
        words = F.split("text", " ")
        # slices of the input may each have a segment's text: it is opened once
        crowd = texts.join(large, "anchor").groupBy("seg1", "seg2").agg(F.min("rank").alias("rank"), F.first("anchor_at").alias("anchor_at"), F.first("text").alias("text"))
        crowd = crowd.select("seg1", "seg2", "anchor_at", "rank", words.alias("w"), F.explode(F.sequence(F.lit(0), F.size(words) - window)).alias("shift"))
        crowd = crowd.select("seg1", "seg2", "shift", (F.col("anchor_at") - F.col("shift")).alias("anchor_at"), "rank", F.array_join(F.slice("w", F.col("shift") + 1, window), " ").alias("text"))
        crowd = written(crowd.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(7), "text")}), "crowded-windows")
        one = crowd.groupBy("d1", "d2").agg(F.min("rank").alias("rank"), F.first("anchor_at").alias("anchor_at"), F.first("text").alias("text"))
        found = resolved(one.select(F.col("d1").alias("place"), F.col("d1").alias("seg1"), F.col("d2").alias("seg2"), F.lit(0).alias("shift"), "anchor_at", "rank", "text"))
        owned = resolved(calm.join(large, "anchor", "left_anti")).unionByName(_together(crowd, found))
    hits = segments.where("text IS NULL").select("rank", "th", "start", "seg1", "seg2").join(owned, ["seg1", "seg2"]).where(F.exists("owners", lambda o: o < F.col("rank")))
    hits = hits.select("rank", "th", F.transform(F.filter(F.sequence(F.lit(0), F.size("owners") - 1), lambda i: F.get("owners", i) < F.col("rank")), lambda i: i + F.col("start") + F.col("shift")).alias("starts"))
    out = written(hits.groupBy("rank", "th").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "repeats")
    for x in (segments, large, crowd):
        drop(x)
    return out


def _anchors_of_rows(window: int, k: int):
    def run(batches):
        for b in sliced(batches):
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for rank, th, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                g, at = anchors(raw.split(), window, k)
                got = np.unique(g[np.unique(at)]).view(np.int64)
                for c, x in zip(cols, (np.full(len(got), rank, np.int64), np.full(len(got), th, np.int64), got), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["rank", "th", "anchor"])

    return run


def covered(n_words: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Whether each word lies in a repeated window."""
    if not starts:
        return np.zeros(n_words, bool)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _with_starts(docs: DataFrame, window: int, id_col: str, text_col: str, **more) -> DataFrame:
    """docs with __sub_raw and __sub_starts, null where nothing repeats."""
    repeats = repeated_windows(docs, window, id_col=id_col, text_col=text_col, **more).withColumnsRenamed({"rank": "__sub_rank", "th": "__sub_th", "starts": "__sub_starts"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__sub_rank": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__sub_th": F.xxhash64(text), "__sub_raw": text.cast("binary")})
    return keyed.join(repeats, ["__sub_rank", "__sub_th"], "left").drop("__sub_rank", "__sub_th")


def kept_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words of each row joined by one space."""

    def run(batches):
        for b in sliced(batches):
            n, gone, kept = [], [], []
            for raw, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = raw.split()
                cover = covered(len(words), starts, window)
                n.append(len(words))
                gone.append(int(cover.sum()))
                kept.append((b" ".join(words) if not gone[-1] else b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c])).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return _with_starts(docs, window, id_col, text_col, **more).select(F.col(id_col).cast("long").alias("doc_id"), "__sub_raw", "__sub_starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cut_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with repeated words cut out of the text, white space between kept words as it was; else unchanged."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # what goes through Python has names of its own
    id_col, text_col = (plain.columns[names.index(c)] for c in (id_col, text_col))
    schema = plain.schema

    def run(batches):
        for b in sliced(batches):
            out = []
            for text, raw, starts in zip(b.column(text_col).to_pylist(), b.column("__sub_raw").to_pylist(), b.column("__sub_starts").to_pylist(), strict=True):
                if not starts:
                    out.append(text)
                    continue
                spans = [m.span() for m in word.finditer(raw)]
                cover = covered(len(spans), starts, window).tolist()
                ends = [0, *(s[0] for s in spans[1:]), len(raw)]  # a word with the white space after it
                out.append(b"".join(raw[ends[i] : ends[i + 1]] for i in range(len(spans)) if not cover[i]).decode())
            columns = [pa.array(out, pa.string()) if f.name == text_col else b.column(i) for i, f in enumerate(schema.fields)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _with_starts(plain, window, id_col, text_col, **more).select(*plain.columns, "__sub_raw", "__sub_starts").mapInArrow(run, schema).toDF(*names)
