"""Language identification by hyperdimensional profiles.

A letter is a random +-1 vector. An n-gram is the product of its letters' vectors, each permuted (rotated) by its
place; a text or a language is the sum of the vectors of its n-grams; they are compared by cosine.

Semantics. A text that is null, empty or without a letter is `und` with score 0. Ties go to the language first in
order. Texts of any length are taken whole. Every input row gives one output row, repeated or null ids included.
Rows with a null language teach nothing; with nothing to learn from every text is `und`. Other columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written

N, ALPHABET, DIMENSIONS, SEED = 3, 40, 512, 7  # n-gram length, letter codes, width of the vectors, of the generator


@functools.cache
def letter_codes() -> np.ndarray:
    """Code of each codepoint: 0 what is no letter, 1-26 a-z, the rest hashed to the other codes, without case."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 % (ALPHABET - 27)
    return out


@functools.cache
def ngram_vectors() -> np.ndarray:
    """The bound vector of every n-gram of letter codes, as +-1 of 8 bits."""
    letters = np.random.default_rng(SEED).integers(0, 2, (ALPHABET, DIMENSIONS), dtype=np.int8) * 2 - 1
    out = letters
    for k in range(1, N):
        moved = np.roll(letters, k, axis=1)
        out = (moved[:, None, :] * out[None, :, :]).reshape(-1, DIMENSIONS)
    return out


def ngrams(text: str) -> np.ndarray:
    """The code of each n-gram of letters; a run of what is no letter counts as one space."""
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = (codes > 0) | (np.append(1, codes[:-1]) > 0)
    codes = np.concatenate([[0], codes[keep], [0]]).astype(np.int32)
    if not codes.any():
        return np.zeros(0, np.int32)
    grams = codes[: len(codes) - N + 1].copy()
    for k in range(1, N):
        grams += codes[k : len(codes) - N + 1 + k] * ALPHABET**k
    return grams


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> pd.DataFrame:
    """A row per language, its prototype the sum of its n-gram vectors, from all rows of `docs`.

    Bundling is a sum, so n-gram counts by language are added up first: a task sends what distinct n-grams it saw,
    at most ALPHABET ** N for each language, and the driver receives no more than that.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            seen: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, []).append(ngrams(text))
            for lang, grams in seen.items():
                total[lang] = total.get(lang, 0) + np.bincount(np.concatenate(grams), minlength=ALPHABET**N)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "gram", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    found = known.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for lang, rows in found.sort_values(["lang", "gram"]).groupby("lang"):
        vector = rows["n"].to_numpy(np.float64) @ ngram_vectors()[rows["gram"].to_numpy()].astype(np.float64)
        out.append((lang, vector / (np.linalg.norm(vector) or 1.0)))
    return pd.DataFrame(out, columns=["lang", "vector"])


def predict(docs: DataFrame, learned: pd.DataFrame, *keep: str | Column, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of each row with the language and the cosine with its prototype (0 to 1), under `names`.

    The prototypes are a few vectors of fixed width; they travel with the task.
    """
    langs = learned["lang"].tolist()
    prototypes = np.vstack(learned["vector"].to_list()).T if langs else np.zeros((DIMENSIONS, 0))

    def run(batches):
        table = ngram_vectors()
        for b in batches:
            lang, score = [], []
            for text in b.column(text_at).to_pylist():
                at, n = np.unique(ngrams(text or ""), return_counts=True)
                if not len(at) or not langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                vector = n.astype(np.float32) @ table[at].astype(np.float32)
                cosines = vector.astype(np.float64) @ prototypes / (np.linalg.norm(vector.astype(np.float64)) or 1.0)
                best = int(np.argmax(cosines))
                lang.append(langs[best])
                score.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:width], *names])

    chosen = docs.select(*keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes)
    text_at = chosen.columns.index(text_col) if text_col in chosen.columns else len(chosen.columns)  # sent once
    width = len(chosen.columns)
    return docs.select(*keep, *([] if text_at < width else [text_col])).mapInArrow(run, schema + f", `{names[0]}` string, `{names[1]}` double")


def keep_known(docs: DataFrame, sigmas: float = 8.0, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language can be told, all columns as they were but a null language, which is filled in.

    A row goes if its text has no letter, or if its cosine is over `sigmas` standard deviations below the mean of the
    rows with a language of like length (powers of two): by Chebyshev's inequality at most 1 / sigmas ** 2 of those
    can go, whatever their distribution. Lengths of which under `least` rows have a language have no such bound, and
    where nothing can be learned only texts without a letter go.
    """
    learned = profiles(docs, text_col, lang_col)
    if learned.empty:
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # what goes through Python has names of its own
    text, lang = (plain.columns[names.index(c)] for c in (text_col, lang_col))
    judged = written(predict(plain, learned, *plain.columns, text_col=text, names=("pred", "cosine")), "judged")
    size = F.floor(F.log2(F.length(text) + 1.0)).alias("size")
    labelled = judged.where(F.col(lang).isNotNull() & (F.col("pred") != "und")).groupBy(size)
    bounds = labelled.agg(F.count("*").alias("n"), F.avg("cosine").alias("m"), F.stddev_pop("cosine").alias("sd")).where(F.col("n") >= least)
    bounds = F.broadcast(bounds.select("size", (F.col("m") - sigmas * F.col("sd")).alias("bound")))  # a row for each power of two
    near = judged.withColumn("size", size).join(bounds, "size", "left")
    near = near.where((F.col("pred") != "und") & (F.col("bound").isNull() | (F.col("cosine") >= F.col("bound"))))
    return near.withColumn(lang, F.coalesce(lang, "pred")).select(plain.columns).toDF(*names)
