"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the loss mask of its tokens is the intersection of
sorted turn spans with token spans, by binary search. Control strings inside texts and roles are escaped reversibly,
so that a reader finds exactly the turns that were written.

Semantics. null text or role: empty. Turns go by `turn` (null first), ties by role, then text. A null conv_id is a
conversation of its own. Rows that repeat are turns that repeat. Texts of any length are taken whole. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.bpe import codec

# The template's marks; the special ids that stand for them lie above the vocabulary.
TURN, SAY, DONE = "<|turn|>", "<|say|>", "<|done|>"
MARKS = (TURN, SAY, DONE)

# Control strings of this and other common templates: <|...|>, <s>, </s>, [INST], [/INST].
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_MARK = re.compile("|".join(map(re.escape, MARKS)))


def escape(text: str) -> str:
    """One backslash more after the opening of each control string."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[tuple[int, int]]]:
    """(formatted text, where marks begin, spans of the texts of assistant turns), in codepoints."""
    out, at, marks, spans = [], 0, [], []
    for role, text in turns:
        role, text = escape(role), escape(text)
        says = at + len(TURN) + len(role)
        start = says + len(SAY)
        marks += [at, says, start + len(text)]
        if role == "assistant":
            spans.append((start, start + len(text)))
        out += [TURN, role, SAY, text, DONE]
        at = start + len(text) + len(DONE)
    return "".join(out), marks, spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns, back from the formatted text."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(SAY)
        turns.append((unescape(role), unescape(rest.removesuffix(DONE))))
    return turns


def masked_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token overlaps a span: both are sorted, so each span is a range found by bisection."""
    edge = np.zeros(len(starts) + 1, np.int64)
    if spans:
        a, b = np.array(spans, np.int64).T
        a, b = a[b > a], b[b > a]
        np.add.at(edge, np.searchsorted(ends, a, side="right"), 1)
        np.add.at(edge, np.searchsorted(starts, b, side="left"), -1)
    return np.cumsum(edge)[:-1] > 0


def encode(bpe, formatted: list[str], marks: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each formatted text its ids and their spans of codepoints; a mark is one special id.

    A token that is part of a codepoint spans the whole of it.
    """
    sizes = [[len(_MARK.match(t, m).group()) for m in ms] for t, ms in zip(formatted, marks, strict=True)]
    cuts = [sorted({*ms, *(m + n for m, n in zip(ms, ns, strict=True) if m + n < len(t))}) for t, ms, ns in zip(formatted, marks, sizes, strict=True)]
    special = {x: len(bpe.vocab) + i for i, x in enumerate(MARKS)}
    out = []
    for text, ms, (starts, pieces) in zip(formatted, marks, bpe.encode(formatted, cuts), strict=True):
        at_mark = dict.fromkeys(ms)
        ids: list[int] = []
        begin: list[int] = []
        end: list[int] = []
        skip = -1
        for k, (s, piece) in enumerate(zip(starts, pieces, strict=True)):
            if s < skip:
                continue
            stop = starts[k + 1] if k + 1 < len(starts) else len(text)
            if s in at_mark:
                mark = _MARK.match(text, s).group()
                skip = s + len(mark)
                ids.append(special[mark])
                begin.append(s)
                end.append(skip)
                continue
            ids += piece
            if len(piece) == 1:
                begin.append(s)
                end.append(stop)
                continue
            raw_at = s
            raw = text[s:stop]
            if raw.isascii():
                for i in piece:
                    begin.append(raw_at)
                    raw_at += len(bpe.vocab[i])
                    end.append(raw_at)
            else:
                char_of = np.repeat(np.arange(len(raw)), [len(c.encode("utf-8", "surrogatepass")) for c in raw])
                b = 0
                for i in piece:
                    n = len(bpe.vocab[i])
                    begin.append(s + int(char_of[b]))
                    end.append(s + int(char_of[b + n - 1]) + 1)
                    b += n
        out.append((np.array(ids, np.int32), np.array(begin, np.int64), np.array(end, np.int64)))
    return out


def masked_text(formatted: str, begin: np.ndarray, end: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text that masked tokens cover, each once."""
    out, at = [], 0
    i = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for a, b in i.reshape(-1, 2).tolist():
        out.append(formatted[max(at, int(begin[a])) : int(end[b - 1])])
        at = int(end[b - 1])
    return out


SCHEMA = "conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_text string, roles array<string>, texts array<string>"


def format_conversations(rows: DataFrame, tokenizer_path: str, chunk: int = 256) -> DataFrame:
    """A row per conversation: formatted text, ids, loss mask, the unescaped text under the mask, the turns read back.

    Turns are dealt by conversation and sorted within partitions, and a task streams over them, holding about `chunk`
    conversations at a time.
    """

    def run(batches):
        bpe = codec(tokenizer_path)

        def done(group: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            rendered = [render(t) for _, t in group]
            encoded = encode(bpe, [r[0] for r in rendered], [r[1] for r in rendered])
            columns: list[list] = [[] for _ in range(7)]
            for (conv, _), (text, _, spans), (ids, begin, end) in zip(group, rendered, encoded, strict=True):
                mask = masked_tokens(begin, end, spans)
                loss = "".join(unescape(x) for x in masked_text(text, begin, end, mask))
                back = read(text)
                for c, x in zip(columns, (conv, text, ids, mask, loss, [r for r, _ in back], [x for _, x in back]), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        group: list[tuple[int | None, list[tuple[str, str]]]] = []
        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not group or group[-1][0] != conv:
                    if len(group) >= chunk:
                        yield done(group)
                        group = []
                    group.append((conv, []))
                group[-1][1].append((role, text))
        if group:
            yield done(group)

    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What identifies each conversation's turns and the text under its loss mask."""
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("input_ids").cast("long").alias("n_tokens"), F.size(F.filter("loss_mask", lambda m: m)).cast("long").alias("n_loss_tokens"),
    )
