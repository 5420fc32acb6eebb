"""Blocks of sets, packed for products in NumPy: frequent members as a matrix of bits, the others as sorted hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKED = "ids binary, fit binary, sizes binary, bits binary, hashes binary, rows binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def packed(batches: Iterable[pa.RecordBatch], frequent: np.ndarray, block: int, members: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (entity, set of hashes, fit) in blocks of `block` rows, fewer where these have over `members` members."""

    def row(ids, sets, fits):
        order = np.argsort(np.array(ids, np.int64), kind="stable")  # equal scores go to the smaller id
        sizes = np.array([len(sets[i]) for i in order], np.int64)
        h = np.concatenate([sets[i] for i in order])
        at = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        known = frequent[place] == h
        dense = np.zeros((len(order), len(frequent)), np.uint8)
        dense[at[known], place[known]] = 1
        h, at = h[~known], at[~known]
        sort = np.argsort(h, kind="stable")
        parts = [np.array(ids, np.int64)[order], np.array(fits, bool)[order], sizes, np.packbits(dense, axis=1), h[sort], at[sort]]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], _NAMES)

    ids, sets, fits, held = [], [], [], 0
    for b in batches:
        lists = b.column(1)
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for i, (e, f) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            one = flat[ends[i] : ends[i + 1]]
            if ids and (len(ids) == block or held + len(one) > members):
                yield row(ids, sets, fits)
                ids, sets, fits, held = [], [], [], 0
            ids.append(e)
            fits.append(f)
            sets.append(one)
            held += len(one)
    if ids:
        yield row(ids, sets, fits)


def _opened(ids: bytes, fit: bytes, sizes: bytes, bits: bytes, hashes: bytes, rows: bytes):
    ids = np.frombuffer(ids, np.int64)
    dense = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(ids), -1), axis=1).astype(np.float32)
    return ids, np.frombuffer(sizes, np.int64), dense, np.frombuffer(hashes, np.int64), np.frombuffer(rows, np.int32)


def _kept(block, which: np.ndarray):
    """A block's rows at the places `which`."""
    ids, sizes, dense, hashes, rows = block
    if len(which) == len(ids):
        return block
    place = np.full(len(ids), -1, np.int32)
    place[which] = np.arange(len(which), dtype=np.int32)
    now = place[rows]
    return ids[which], sizes[which], dense[which], hashes[now >= 0], now[now >= 0]


def _shared(a, b, step: int = 4_000_000) -> np.ndarray:
    """Common members of each row of one block with each of the other."""
    _, _, da, ha, ra = a
    _, _, db, hb, rb = b
    out = np.rint(da @ db.T).astype(np.int32).ravel()
    lo = np.searchsorted(hb, ha, "left")
    n = np.searchsorted(hb, ha, "right") - lo
    some = n > 0
    lo, n, ra = lo[some], n[some], ra[some].astype(np.int64) * len(db)
    ends, begin = np.cumsum(n), 0
    while begin < len(n):  # a bounded number of meetings at a time
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + step, "right")))
        k = n[begin:end]
        first = np.cumsum(k) - k
        there = np.arange(int(k.sum())) + np.repeat(lo[begin:end] - first, k)
        out += np.bincount(np.repeat(ra[begin:end], k) + rb[there], minlength=len(out)).astype(np.int32)
        begin = end
    return out.reshape(len(da), len(db))


def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, nearest, similarity) from pairs of packed blocks: for each row of a first block the best of the fit rows
    that it has met here, or none and 0."""
    mine, a, best, who = None, None, None, None

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(who, mask=best == 0), pa.array(best)], ["entity", "nearest", "similarity"])

    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, second = values[: len(_NAMES)], values[len(_NAMES) :]
            if first[0] != mine:
                if a is not None:
                    yield rows()
                mine, a = first[0], _opened(*first)
                best, who = np.zeros(len(a[0])), np.zeros(len(a[0]), np.int64)
            fit, sizes = np.frombuffer(second[1], bool), np.frombuffer(second[2], np.int64)
            if not fit.any():
                continue
            # of two sets no more than the smaller is shared, of no fewer than the larger
            near = np.clip(a[1], sizes.min(), sizes.max())
            go = np.flatnonzero(np.minimum(a[1], near) / np.maximum(a[1], near) >= best)
            if not len(go):
                continue
            part, b = _kept(a, go), _kept(_opened(*second), np.flatnonzero(fit))
            c = _shared(part, b)
            c[part[0][:, None] == b[0][None, :]] = 0  # not itself
            score = c / (part[1][:, None] + b[1][None, :] - c)
            at = score.argmax(1)
            top, other = score[np.arange(len(go)), at], b[0][at]
            better = (top > best[go]) | ((top == best[go]) & (top > 0) & (other < who[go]))
            best[go[better]], who[go[better]] = top[better], other[better]
    if a is not None:
        yield rows()
