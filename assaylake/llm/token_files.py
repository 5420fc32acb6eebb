"""Token ids in shard files, each a wavelet matrix: a file that answers questions without being unpacked.

A shard holds a run of the corpus's ids, in ascending order of documents. Each bit of the ids is a plane of bits; a
level keeps ids with a 0 before those with a 1, in order, so that ranks in its plane lead to the next. Planes lie in
compressed blocks beside their offsets and counts: reading one id, counting one in a range or finding its k-th
occurrence touches a block or two a level.

Semantics. null text: empty, so that the document is its end id alone. Documents go by id, null first; rows whose ids
tie go in the order of the table, each a document of its own. Texts of any length are encoded whole; a document that
does not fit what is left of a shard goes on in the next. Special tokens' strings in a text are ordinary text. Other
columns are not read. An empty table gives no shards.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import drop, written
from assaylake.llm.packing import Remembered, byte_letters, is_latin1

MAGIC = b"WVM1"
BLOCK = 1 << 16  # bits of a plane that are compressed together
_HEAD = struct.Struct("<4sBQQQQ")  # magic, levels, ids, documents, bytes of the index, ids before in the partition


# ---- the file ----


def build(ids: np.ndarray, index: dict[str, np.ndarray], before: int = 0) -> bytes:
    """A shard's file: `ids` and, for each piece of a document, what `index` has (arrays of 64-bit integers)."""
    levels = max(1, int(ids.max(initial=0)).bit_length())
    seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1)
    zeros, directory, body, at = [], [], [], 0
    for level in reversed(range(levels)):
        bit = (seq >> level) & 1 == 1
        packed = np.packbits(bit, bitorder="little").tobytes()
        ones = np.array([np.count_nonzero(bit[i : i + BLOCK]) for i in range(0, len(bit), BLOCK)], np.int64)
        offsets = []
        for i in range(0, len(packed), BLOCK // 8):
            raw = packed[i : i + BLOCK // 8]
            small = squeeze.compress(raw)
            part = small if len(small) < len(raw) else raw  # a block of full length is stored as it is
            offsets.append(at)
            body.append(part)
            at += len(part)
        directory += [np.array([*offsets, at], "<u8"), np.concatenate([[0], np.cumsum(ones)]).astype("<u8")]
        low = np.compress(~bit, seq)  # several times faster than a mask as index
        zeros.append(len(low))
        seq = np.concatenate([low, np.compress(bit, seq)])
    names = sorted(index)
    tables = [np.array(zeros, "<u8"), *directory, *(index[n].astype("<i8") for n in names)]
    packed_index = squeeze.compress(",".join(names).encode() + b"\n" + b"".join(t.tobytes() for t in tables))
    return b"".join([_HEAD.pack(MAGIC, levels, len(ids), len(index[names[0]]) if names else 0, len(packed_index), before), packed_index, *body])


class Shard:
    """Reads a shard through `read(offset, size)`; only its index and the blocks asked for are fetched."""

    def __init__(self, read: Callable[[int, int], bytes], blocks_held: int = 256):
        magic, self.levels, self.n, pieces, size, self.before = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._read, self._body = read, _HEAD.size + size
        raw = zstandard.ZstdDecompressor().decompress(read(_HEAD.size, size))
        names, _, rest = raw.partition(b"\n")
        at = 0

        def table(count: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(rest, kind, count, at)
            at += 8 * count
            return found.astype(np.int64)

        blocks = -(-self.n // BLOCK)
        self.zeros = table(self.levels, "<u8")
        self.offsets, self.ranks = [], []
        for _ in range(self.levels):
            self.offsets.append(table(blocks + 1, "<u8"))
            self.ranks.append(table(blocks + 1, "<u8"))
        self.index = {n.decode(): table(pieces, "<i8") for n in names.split(b",") if n}
        self._block = functools.lru_cache(maxsize=blocks_held)(self._fetch)

    @classmethod
    def of_bytes(cls, data: bytes) -> Shard:
        return cls(lambda at, size: data[at : at + size])

    def _bytes(self, level: int, block: int) -> int:
        return (min(BLOCK, self.n - block * BLOCK) + 7) // 8

    def _unpacked(self, raw: bytes, size: int) -> bytes:
        return raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)

    def _fetch(self, level: int, block: int) -> np.ndarray:
        a, b = self.offsets[level][block : block + 2].tolist()
        size = self._bytes(level, block)
        raw = self._unpacked(self._read(self._body + a, b - a), size)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: min(BLOCK, self.n - block * BLOCK)]

    def _rank(self, level: int, at: int) -> int:
        """Ones of a level's plane before `at`."""
        block, rest = divmod(at, BLOCK)
        return int(self.ranks[level][block]) + (int(self._block(level, block)[:rest].sum()) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) `bit` of a level's plane is."""
        ranks = self.ranks[level]
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[k - int(ranks[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.levels):
            bit = int(self._block(level, at // BLOCK)[at % BLOCK])
            ones = self._rank(level, at)
            at = int(self.zeros[level]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _narrowed(self, token: int, a: int, b: int) -> tuple[int, int]:
        if not 0 <= token < 1 << self.levels:
            return 0, 0
        for level in range(self.levels):
            ones = self._rank(level, a), self._rank(level, b)
            if token >> (self.levels - 1 - level) & 1:
                a, b = int(self.zeros[level]) + ones[0], int(self.zeros[level]) + ones[1]
            else:
                a, b = a - ones[0], b - ones[1]
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often an id occurs in places a to b, b not included."""
        b = self.n if b is None else min(b, self.n)
        low, high = self._narrowed(token, min(a, b), b)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id."""
        low, high = self._narrowed(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def occurrences(self, token: int, a: int = 0, b: int | None = None) -> Iterator[int]:
        """All places of an id in a range, in order."""
        first = self.count(token, 0, a)
        for k in range(first, first + self.count(token, a, b)):
            yield self.select(token, k)

    def ids(self) -> np.ndarray:
        """All ids: the levels undone from the last to the first, each a merge of its two halves."""
        squeeze = np.uint16 if self.levels <= 16 else np.uint32
        seq = np.zeros(self.n, squeeze)
        for level in reversed(range(self.levels)):
            offsets = self.offsets[level].tolist()
            raw = self._read(self._body + offsets[0], offsets[-1] - offsets[0])
            plane = b"".join(self._unpacked(raw[a - offsets[0] : b - offsets[0]], self._bytes(level, i)) for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[: self.n].view(bool)
            up = np.empty_like(seq)
            cut = int(self.zeros[level])
            up[np.flatnonzero(~bit)] = seq[:cut]
            up[np.flatnonzero(bit)] = seq[cut:] | squeeze(1 << (self.levels - 1 - level))
            seq = up
        return seq.astype("<u4")


def open_shard(uri: str) -> Shard:
    store, path = fs.FileSystem.from_uri(uri)
    source = store.open_input_file(path)

    def read(at: int, size: int) -> bytes:
        source.seek(at)
        return source.read(size)

    return Shard(read)


# ---- ids of texts ----

#: The pattern by which byte-level vocabularies of this family cut a text.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ENDS = (",", ".", "!", "?", ":", ";")
_SURE_ENDS = "\u0250"  # below it all versions of Unicode agree on what is a letter or a number


class _Run(Exception):
    """A longer run of white space: the text is left to the library."""


class ByteTokenizer:
    """Ids of whole texts by a byte-level tokenizer, with those of words remembered up to `cache_size` words.

    Its pattern begins anew wherever a single white space follows something, so a text's ids are those of its words,
    each with the space or line end before it. A word not yet known is cut by the pattern and its parts are merged by
    the library's model; texts with longer runs of white space go through the library as they are.
    """

    def __init__(self, path: str, cache_size: int = 500_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # one thread for each Spark task
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_size = Tokenizer.from_file(path), cache_size
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.known: dict[str, bytes] = Remembered(self._latin)
        self.space = self.letters[32]
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            bare = part[0] == " " and part.isascii() and part[1:].isalpha()  # what most words are
            letters = self.space + part[1:] if bare else part.encode().decode("latin-1").translate(self.letters)
            raw = self.raw
            found = b"".join([raw[t.id] for t in self.merge(letters)])
            if len(part) <= 50:
                self.parts[part] = found
        return found

    def _latin(self, word: str) -> bytes:
        """Ids of a word of Latin-1 letters, with what stands before it as in _learn()."""
        if word.isalpha():
            return self._merged(" " + word)
        if word[-1:] in _ENDS and word[:-1].isalpha():
            return self._merged(" " + word[:-1]) + self._merged(word[-1])
        core = word.lstrip("\n")
        if not core or core[0].isspace():
            raise _Run
        text = core if word.startswith("\n\n") else word if word[0] == "\n" else " " + word
        return b"".join([self._merged(p) for p in _CUT.findall(text)])

    def _learn(self, words: list[str]) -> None:
        """Ids of words with what stands before them: a space, a line end, or (after two line ends) nothing."""
        far, merged, known = {}, self._merged, self.known
        for w in words:
            near = w.isascii() or max(w) < _SURE_ENDS
            if near and w.isalpha():  # most words, and most of the others end in one mark
                known[w] = merged(" " + w)
                continue
            if near and w[-1:] in _ENDS and w[:-1].isalpha():
                known[w] = merged(" " + w[:-1]) + merged(w[-1])
                continue
            core = w.lstrip("\n")
            if not core or core[0].isspace():
                continue  # a longer run of white space: left to the library with the whole text
            text = core if w.startswith("\n\n") else w if w[0] == "\n" else " " + w
            if near:
                known[w] = b"".join([merged(p) for p in _CUT.findall(text)])
            else:
                far[w] = text
        known.update(zip(far, self._library(list(far.values())), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        for held in (known, self.parts):
            if len(held) > self.cache_size:
                held.clear()
        cut, found, new = [], [], set()
        get = known.__getitem__
        for t in texts:
            words = t.replace("\n", " \n").split(" ")
            words[0] = "\n\n" + words[0]
            if is_latin1(t):
                try:
                    found.append([b"".join(map(get, words))])
                except _Run:
                    found.append(self._library([t]))
                cut.append(None)
                continue
            ids = list(map(known.get, words))
            if None in ids:
                new.update([w for w, x in zip(words, ids, strict=True) if x is None])
            cut.append(words)
            found.append(ids)
        self._learn(list(new))
        for i, ids in enumerate(found):
            if None in ids:
                ids = list(map(known.get, cut[i]))
                found[i] = self._library([texts[i]]) if None in ids else ids
        for w in new:
            if len(w) > 100:
                known.pop(w, None)
        return [np.frombuffer(b"".join(x), "<u4") for x in found]


@functools.lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


# ---- tables to files and back ----

MANIFEST = "part int, shard int, path string, before long, tokens long, bytes long"
PIECES = "part int, ordinal long, doc_id long, base long, piece_start long, length long, doc_tokens long, crc long"


class _Writer:
    """The ids of one task's documents, put into files of `shard_tokens` as soon as there are enough."""

    def __init__(self, folder: str, part: int, shard_tokens: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.path, recursive=True)
        self.folder, self.part, self.shard_tokens = folder, part, shard_tokens
        self.held: list[np.ndarray] = []
        self.pieces: list[tuple[int, int, int, int, int, int]] = []
        self.size, self.before, self.shards, self.ordinal = 0, 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.shard_tokens - self.size]
            self.held.append(part)
            self.pieces.append((self.ordinal, doc_id or 0, doc_id is None, at, len(part), len(ids)))
            self.size += len(part)
            at += len(part)
            if self.size == self.shard_tokens:
                yield from self.flush()
        self.ordinal += 1

    def flush(self) -> Iterator[tuple]:
        if not self.size:
            return
        table = np.array(self.pieces, np.int64)
        index = {n: table[:, i] for i, n in enumerate(("ordinal", "doc_id", "no_id", "piece_start", "length", "doc_tokens"))}
        data = build(np.concatenate(self.held), index, self.before)
        name = f"{self.part:06d}-{self.shards:06d}-{uuid.uuid4().hex}.wvm"  # an attempt that is lost leaves no name behind
        with self.store.open_output_stream(f"{self.path}/{name}") as f:
            f.write(data)
        yield self.part, self.shards, f"{self.folder}/{name}", self.before, self.size, len(data)
        self.before += self.size
        self.shards += 1
        self.held, self.pieces, self.size = [], [], 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, each with `end_id` after it, to files in `folder`; gives their manifest.

    Documents are dealt to tasks by ranges of their id, in which rows of one id are parted too; a task streams over its
    documents and holds one shard at most. `folder` is a URI or path that all executors reach. The manifest, itself a
    written table, lists the files of attempts that ended well.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("id"), F.asc("place")]

    def run(batches):
        encode = byte_tokenizer(tokenizer_path)
        out = _Writer(folder, TaskContext.get().partitionId(), shard_tokens)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # a bounded number of texts at a time
                part = b.slice(at, 64)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    found = list(out.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4")))
                    if found:
                        yield _batch(found, MANIFEST)
        found = list(out.flush())
        if found:
            yield _batch(found, MANIFEST)

    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    start is the number of ids in all documents before it. The driver adds up one number for each task that wrote. The
    result is a written table, so the files may go once it is there.
    """
    spark = manifest.sparkSession
    base, bases, shards = 0, [], 0
    for r in manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("shards")).orderBy("part").collect():
        bases.append((r.part, base))
        base, shards = base + r.tokens, shards + r.shards
    files = manifest.join(spark.createDataFrame(bases, "part int, base long"), "part").select("part", "path", "base").repartition(max(1, min(shards, 20_000)))

    def run(batches):
        for b in batches:
            for part, path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = open_shard(path)
                ids, at, rows = shard.ids(), 0, []
                x = shard.index
                for ordinal, doc, no_id, start, length, total in zip(*(x[n].tolist() for n in ("ordinal", "doc_id", "no_id", "piece_start", "length", "doc_tokens")), strict=True):
                    rows.append((part, ordinal, None if no_id else doc, base + shard.before + at - start, start, length, total, zlib.crc32(ids[at : at + length].tobytes())))
                    at += length
                yield _batch(rows, PIECES)

    pieces = written(files.mapInArrow(run, PIECES), "token-pieces")
    whole = pieces.where("length = doc_tokens").select("doc_id", F.col("base").alias("start"), F.col("doc_tokens").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_start")
        crc = 0
        for c, n in zip(group["crc"].tolist(), group["length"].tolist(), strict=True):
            crc = crc_of_both(crc, c, 4 * n)
        out = group.head(1)[["doc_id", "base", "doc_tokens"]].rename(columns={"base": "start", "doc_tokens": "n_tokens"})
        return out.assign(ids_crc32=crc)

    # a document's pieces are as many as the shards it runs through, which a text's greatest length bounds
    cut = pieces.where("length < doc_tokens").groupBy("part", "ordinal").applyInPandas(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = written(whole.unionByName(cut), "token-places")
    drop(pieces)
    return found


def _times(rows: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= rows[i]
        vector >>= 1
        i += 1
    return out


def crc_of_both(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings one after the other, from their own: zero bytes act on it as a bit matrix, squared
    for each power of two."""
    zero_bit = [0xEDB88320] + [1 << i for i in range(31)]
    step = zero_bit
    for _ in range(3):
        step = [_times(step, r) for r in step]  # eight zero bits
    while second_bytes:
        if second_bytes & 1:
            first = _times(step, first)
        step = [_times(step, r) for r in step]
        second_bytes >>= 1
    return first ^ second

