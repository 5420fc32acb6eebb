"""Byte-level BPE: boundaries by an associative scan over codepoint classes, cached pair merging, exact decoding.

Semantics. null text: empty text (no ids, decoded to no bytes). Texts of any length are taken whole. Rows repeat,
ids may be null or tie: every input row gives one output row. Other input columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unicode White_Space (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# What a codepoint is to the pattern, given the codepoint after it.
OTHER, LETTER, NUMBER, QUOTE, SHORT, LONG, LAST_SPACE, LAST_WHITE, INNER_WHITE, RESET = range(10)
# What kind of token the scan is in.
FRESH, SPACED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LONE_QUOTE, IN_WHITE, HALF_SUFFIX = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts at this symbol).

    SHORT is one of s t m d, LONG the first letter of re ve ll: after a lone quote they are its suffix.
    LAST_SPACE is a space before something else, the optional prefix of what follows.
    """
    if symbol == RESET:
        return FRESH, True
    if symbol == INNER_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol == LAST_WHITE:
        return FRESH, True
    if symbol == LAST_SPACE:
        return SPACED, True
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, SPACED)
    if symbol in (OTHER, QUOTE):
        inside = state in (IN_OTHERS, LONE_QUOTE, SPACED)
        return (IN_OTHERS if inside or symbol == OTHER else LONE_QUOTE), not inside
    if state == HALF_SUFFIX:
        return FRESH, False
    if state == LONE_QUOTE and symbol != LETTER:
        return (FRESH if symbol == SHORT else HALF_SUFFIX), False
    return IN_LETTERS, state not in (IN_LETTERS, SPACED)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The finite set of transition functions closed under composition, as tables.

    (element of each symbol, element of two composed, state each element leads to from FRESH, whether an element
    leads to one state from anywhere, whether a token starts by state and symbol)
    """
    gens = [tuple(_step(q, s)[0] for q in range(8)) for s in range(10)]
    elements = list(dict.fromkeys(gens))
    for f in elements:  # grows while it runs
        for g in gens:
            h = tuple(g[f[q]] for q in range(8))
            if h not in elements:
                elements.append(h)
    index = {f: i for i, f in enumerate(elements)}
    then = np.array([[index[tuple(g[f[q]] for q in range(8))] for g in elements] for f in elements], np.uint8)
    return (
        np.array([index[g] for g in gens], np.uint8), then, np.array([f[FRESH] for f in elements], np.uint8),
        np.array([len(set(f)) == 1 for f in elements]), np.array([[_step(q, s)[1] for s in range(10)] for q in range(8)]),
    )


@functools.cache
def _classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or INNER_WHITE of every codepoint."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = INNER_WHITE
    return out


def _symbols(cps: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    sym = _classes()[cps]
    sym[breaks] = RESET
    after = np.append(cps[1:], 0)
    solid = np.append((sym[1:] != INNER_WHITE) & (sym[1:] != RESET), False)
    last = (sym == INNER_WHITE) & solid
    e, low_l = ord("e"), ord("l")
    sym[last] = np.where(cps[last] == 0x20, LAST_SPACE, LAST_WHITE)
    near = np.flatnonzero((cps == 0x27) & (sym == OTHER))
    sym[near] = QUOTE
    near = near[near + 1 < len(cps)] + 1  # only letters just after a quote, and the one after those, can be a suffix
    c, d = cps[near], after[near]
    letters = sym[near] == LETTER
    sym[near[letters & np.isin(c, [ord(x) for x in "stmd"])]] = SHORT
    sym[near[letters & (np.isin(c, [ord("r"), ord("v")]) & (d == e) | (c == low_l) & (d == low_l))]] = LONG
    return sym


def token_starts(cps: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, in an array of codepoints; `breaks` are separators between texts, each its own token.

    Each codepoint is a transition function of a small automaton; composing functions is associative, so prefixes
    are composed by doubling. Most functions lead to one state from anywhere, so a few rounds settle every prefix.
    """
    if not len(cps):
        return np.empty(0, np.int64)
    gen, then, lead, settled, starts = _monoid()
    sym = _symbols(cps, breaks)
    e, d = gen[sym], 1
    while d < len(e) and not settled[e[d:]].all():
        e = np.concatenate([e[:d], then[e[:-d], e[d:]]])
        d *= 2
    before = np.concatenate([[FRESH], lead[e[:-1]]])
    return np.flatnonzero(starts[before, sym])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encodes many texts at once; piece ids are remembered up to `cache_size` pieces."""

    def __init__(self, path: str, cache_size: int = 300_000, chunk_chars: int = 1_000_000):
        self.ranks = load_ranks(path)
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.vocab[v] = k
        self.decimals = [str(i) for i in range(len(self.vocab))]
        self.cache_size, self.chunk_chars = cache_size, chunk_chars
        self.bytes_to_id = [self.ranks[bytes([i])] for i in range(256)]
        #: the id that two adjacent ids join to
        self.pairs = {self.ranks[a] << 32 | self.ranks[b]: r for k, r in self.ranks.items() for i in range(1, len(k)) if (a := k[:i]) in self.ranks and (b := k[i:]) in self.ranks}
        self._ids: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        parts = list(map(self.bytes_to_id.__getitem__, piece))
        if len(parts) > 200:
            return self._merge_long(parts)
        pair, never = self.pairs.get, len(self.vocab)
        ranks = [pair(a << 32 | b, never) for a, b in itertools.pairwise(parts)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i] = best
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pair(best << 32 | parts[i + 1], never)
            if i:
                ranks[i - 1] = pair(parts[i - 1] << 32 | best, never)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list, for pieces of any length."""
        pair, n = self.pairs.get, len(parts)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pair(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], right[i] = r, 1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := pair(parts[p] << 32 | parts[q])) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return tuple(p for i, p in enumerate(parts) if not gone[i])

    def _looked_up(self, pieces: list[str]) -> list[tuple[int, ...]]:
        known = self._ids
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > self.cache_size:
                known.clear()
            for i, x in enumerate(out):
                if x is None:
                    p = pieces[i]
                    if (ids := known.get(p)) is None:
                        ids = self.merge(p.encode("utf-8", "surrogatepass"))
                        if len(p) < 64:
                            known[p] = ids
                    out[i] = ids
        return out

    def encode(self, texts: list[str], cuts: list[list[int]] | None = None) -> Iterator[tuple[list[int], list[tuple[int, ...]]]]:
        """For each text, the start of each piece (in codepoints) and the ids of each piece.

        `cuts`: places where a piece must also begin, by text, besides those that the pattern finds.
        """
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            group.append(k)
            size += len(t) + 1
            if size >= self.chunk_chars or k == len(texts) - 1:
                yield from self._encode_group([texts[i] for i in group], [cuts[i] for i in group] if cuts else None)
                group, size = [], 0

    def _encode_group(self, texts: list[str], cuts: list[list[int]] | None) -> Iterator[tuple[list[int], list[tuple[int, ...]]]]:
        joined = "\n".join(texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = token_starts(cps, ends)
        if cuts:
            first = np.concatenate([[0], ends[:-1] + 1])
            starts = np.union1d(starts, np.concatenate([first[k] + np.asarray(c, np.int64) for k, c in enumerate(cuts)]).astype(np.int64))
        marks = starts.tolist()
        ids = self._looked_up([joined[a:b] for a, b in zip(marks, [*marks[1:], len(joined)], strict=True)])
        at, base = 0, 0
        for end in np.searchsorted(starts, ends).tolist():
            yield [m - base for m in marks[at:end]], ids[at:end]
            base, at = marks[end] + 1, end + 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, starts array<long>): the ids of each text, and the byte at which each begins.

    Decoding ids[a:b] gives the bytes from starts[a] up to starts[b].
    """

    def run(batches):
        bpe = codec(tokenizer_path)
        width = np.array([len(x) for x in bpe.vocab], np.int64)
        for batch in batches:
            ids = [np.fromiter(itertools.chain.from_iterable(x), np.int32) for _, x in bpe.encode(batch.column(1).to_pylist())]
            starts = [np.concatenate([[0], np.cumsum(width[x])[:-1]]) if len(x) else x.astype(np.int64) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64()))], ["doc_id", "ids", "starts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to.

    One pass over the scan, nothing shuffled; ids never leave the task.
    """

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for _, pieces in bpe.encode(batch.column(1).to_pylist()):
                ids = list(itertools.chain.from_iterable(pieces))
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
