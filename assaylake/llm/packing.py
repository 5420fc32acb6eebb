"""First-fit-decreasing packing of tokenised documents into fixed-length sequences.

Semantics. null text: empty, so that the document is its end-of-document id alone. A document longer than a
sequence is cut at multiples of the sequence length; every id lies in exactly one piece. Rows may repeat and ids
may be null or tie: each input row is packed for itself. Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


_LATIN_ENDS = "\u0250"  # below it no letter is composed of others, and none changes its case by what stands around it


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of bytes: itself if it is seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(unseen)}


_BYTE_LETTERS = byte_letters()


def _cut(layout: dict) -> regex.Pattern | None:
    """The pattern that cuts a lower-cased text into what is merged by itself, if the tokenizer works in that way."""
    normal = [x["type"] for x in (layout.get("normalizer") or {}).get("normalizers", [])]
    steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
        if steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            return regex.compile(steps[0]["pattern"]["Regex"])
    return None


class Remembered(dict):
    """A dictionary that asks `learn` for what it lacks; what is longer than 100 letters is not kept."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        found = self.learn(key)
        if len(key) <= 100:
            self[key] = found
        return found


def is_latin1(text: str) -> bool:
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


class WordTokenizer:
    """Ids of whole texts, with ids of white-space separated words remembered up to `cache_size` words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in order.
    Words not yet known are encoded many at a time. Latin words are first cut as the tokenizer's own pattern cuts them,
    after lower-casing: its merges never cross a cut, so "Word," needs "word" and "," alone, mostly known already.
    """

    def __init__(self, path: str, cache_size: int = 500_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # one thread for each Spark task
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_size = Tokenizer.from_file(path), cache_size
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = Remembered(self._latin)
        self.pieces: dict[str, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.ends))]
        with open(path, encoding="utf-8") as f:
            self.cut = _cut(json.load(f))
        #: marks that the pattern cuts from the letters before them
        self.marks = {m for m in ",.!?;:" if self.cut and self.cut.findall("a" + m) == ["a", m] and self.cut.findall("\xe9x" + m) == ["\xe9x", m]}

    def _piece(self, x: str) -> bytes:
        found = self.pieces.get(x)
        if found is None:
            letters = x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_BYTE_LETTERS)
            raw = self.raw
            found = b"".join([raw[t.id] for t in self.merge(letters)])
            if len(x) <= 100:
                self.pieces[x] = found
        return found

    def _latin(self, word: str) -> bytes:
        """Ids of a word of Latin-1 letters by itself."""
        x = word.lower()
        if x.isalpha():
            if x is not word and x in self.known:
                return self.known[x]
            raw = self.raw
            return b"".join([raw[t.id] for t in self.merge(x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LETTERS))])
        if x[-1] in self.marks and x[:-1].isalpha():
            return self.known[x[:-1]] + self._piece(x[-1])
        return b"".join([self._piece(p) for p in self.cut.findall(x)])

    def _learn(self, words: list[str]) -> None:
        whole, cut = words, {}
        if self.cut:
            low = {w: w.lower() for w in words if w.isascii() or max(w) < _LATIN_ENDS}
            cut = {w: [x] if x.isalpha() else self.cut.findall(x) for w, x in low.items()}  # a letter may become one and a mark
            whole = [w for w in words if w not in cut]
            merge = self.tokenizer.model.tokenize
            for x in {x for c in cut.values() for x in c if x not in self.pieces}:
                letters = x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_BYTE_LETTERS)
                self.pieces[x] = b"".join([self.raw[t.id] for t in merge(letters)])
        for w, c in cut.items():
            self.known[w] = b"".join([self.pieces[x] for x in c])
        # letters alone are one unit of the tokenizer, so its word ends part them; other words are parted by offsets
        plain = [w for w in whole if w.isalpha()]
        for i in range(0, len(plain), 2000):
            self._parted(plain[i : i + 2000], by_ends=True)
        rest = [w for w in whole if not w.isalpha()]
        for i in range(0, len(rest), 2000):
            self._parted(rest[i : i + 2000], by_ends=False)

    def _parted(self, words: list[str], by_ends: bool) -> None:
        found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        if by_ends:
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(words):
                return self._parted(words, by_ends=False)
        else:
            stops = np.cumsum([len(w) + 1 for w in words])
            cuts = np.searchsorted(np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0], stops)
        raw, at = ids.tobytes(), 0
        for w, to in zip(words, (4 * cuts).tolist(), strict=True):
            self.known[w] = raw[at:to]
            at = to

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        known, out, late, ids = self.known, [], [], self.known.__getitem__
        if len(known) > self.cache_size:
            known.clear()
        if len(self.pieces) > self.cache_size:
            self.pieces.clear()
        for t in texts:
            words = list(filter(None, _ASCII_SPACE.split(t))) if _ODD_SPACE.search(t) else t.split()
            if self.cut and is_latin1(t):
                out.append([b"".join(map(ids, words))])
                continue
            found = list(map(known.get, words))
            if None in found:
                late.append((found, [(i, words[i]) for i, x in enumerate(found) if x is None]))
            out.append(found)
        if late:
            new = list({w for _, gaps in late for _, w in gaps})
            self._learn(new)
            for found, gaps in late:
                for i, w in gaps:
                    found[i] = known[w]
            for w in new:
                if len(w) > 100:
                    known.pop(w, None)
                    self.pieces.pop(w.lower(), None)
        return [np.frombuffer(b"".join(x), "<u4") for x in out]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids with `end_id` after them, cut."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encode = word_tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a bounded number of texts at a time
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in names]
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), length):
                        cut = ids[start : start + length]
                        for column, x in zip(rows, (doc, start, len(cut), zlib.crc32(cut.tobytes()), len(ids), cut.astype(np.int32)), strict=False):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, x in zip(names, rows, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, schema)


class Tournament:
    """Free space of bins as the leaves of a tree of maxima; finds the first bin with room in log(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)"""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        at, offset = i - self.leaves, self.capacity - tree[i]
        tree[i] -= size
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
        return at, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, which must be in falling order; sizes that fill a bin are placed at once."""
    full = int(np.searchsorted(-sizes, -capacity, side="right"))
    bins, offsets = np.arange(len(sizes), dtype=np.int64), np.zeros(len(sizes), np.int64)
    rest = sizes[full:].tolist()
    if rest:
        tree = Tournament(len(rest), capacity)
        placed = np.array([tree.place(s) for s in rest], np.int64)
        bins[full:], offsets[full:] = placed[:, 0] + full, placed[:, 1]
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, docs_per_group: int = 20_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset of each.

    Pieces are dealt to groups, one for about `docs_per_group` documents, by a hash of id, place and content, and each group is packed
    by itself: a group's size does not grow with the table, and no key, a null id included, gathers in one group.
    Only lengths and checksums are shuffled, unless `with_ids`.
    """
    groups = max(1, math.ceil(docs.count() / docs_per_group))
    cut = pieces(docs, tokenizer_path, length, end_id, with_ids, id_col, text_col)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        out = rows.drop(columns="pack_group")
        out["sequence_id"], out["offset"] = int(rows["pack_group"].iloc[0]) * 2**32 + bins, offsets
        return out

    group = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32", F.lit("pack")), F.lit(groups))
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return cut.withColumn("pack_group", group).groupBy("pack_group").applyInPandas(run, schema)
