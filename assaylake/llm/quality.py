"""Quality scores: statistics of a document, random Fourier features of them, ridge regression, isotonic calibration.

Semantics. null text: the empty text, which is scored like any other. Texts of any length are taken whole. Every
input row gives one output row, repeated or null ids included. Labels that are null teach nothing; an id labelled
twice teaches twice; with no labels at all every score is 0.5. Only the text enters a score.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import written

STATISTICS = ["log_bytes", "letters", "upper", "digits", "blanks", "stops", "shouts", "bars", "symbols", "lines", "log_words", "word_bytes", "distinct_words", "repeated_words", "distinct_lines"]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars.encode("latin-1"))] = 1
    return out


_LOWER, _UPPER = _mask("abcdefghijklmnopqrstuvwxyz"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HIGH = (np.arange(256) >= 128).astype(np.float64)
_BYTES = np.stack([_LOWER + _UPPER + _HIGH, _UPPER, _mask("0123456789"), _mask(" \t\r\v\f"), _mask(".,;:?'\"()-"), _mask("!"), _mask("|"), _mask("#$%&*+/<=>@[\\]^_`{}~"), _mask("\n")], axis=1)


def statistics(raw: bytes) -> np.ndarray:
    """Shares of kinds of bytes, words and lines of the whole text; accented letters count as letters by their bytes."""
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _BYTES
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    again = sum(map(operator.eq, words, words[1:]))
    out = np.empty(len(STATISTICS))
    out[0] = np.log1p(len(raw))
    out[1:10] = kinds / n
    out[2] = kinds[1] / max(1.0, kinds[0])
    out[10:] = np.log1p(len(words)), np.log1p(sum(map(len, words)) / w), len(set(words)) / w, again / w, len(set(lines)) / len(lines)
    return out


def _statistics_rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    if not batch.num_rows:
        return np.zeros((0, len(STATISTICS)))
    return np.stack([statistics(x) for x in batch.column(column).to_pylist()])


@dataclass
class Model:
    """A fixed number of floats, whatever the input: it travels with the task."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores and the calibrated score at each
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([wave, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.steps, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising levels of y, at the mean x of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    at = np.array(pools)
    return at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fold: Column | None = None, sample_rows: int = 60_000, width: int = 256, bandwidth: float = 2.5, ridge: float = 1e-2, seed: int = 11) -> Model:
    """Learn from labelled rows of `docs`: at most `sample_rows` labels, those whose ids hash lowest.

    `fold` is 0 where a row fits the ridge and 1 where it calibrates (a third of the rows, by default). Each
    partition sends its sums of the normal equations, width squared numbers; the sample is in eight partitions.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)).eqNullSafe(F.lit(0)).cast("int") if fold is None else fold
    labelled = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("double").alias("y"))
    place = F.xxhash64("doc_id", F.lit(seed))
    share = 1.3 * sample_rows / max(1, labelled.count())  # so many reach the sort, however large the table
    lowest = labelled.where(place < int(-(2**63) + share * 2**64)) if share < 1 else labelled
    chosen = lowest.orderBy(place, "doc_id", "y").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), fold.alias("fold")).join(F.broadcast(chosen), "doc_id").select("y", "fold", "raw")  # the sample's bound is the broadcast's

    def measure(batches):
        for b in batches:
            x = _statistics_rows(b, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "fold", "x"])

    sample = written(rows.mapInArrow(measure, "y double, fold int, x array<double>").repartition(8), "quality-sample")
    k = len(STATISTICS)
    moments = sample.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(k)]).alias("m"), F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(k)]).alias("s")).first()
    rng = np.random.default_rng(seed)
    mean, scale = (np.array([v if v is not None else d for v in (moments[c] or [d] * k)]) for c, d in (("m", 0.0), ("s", 1.0)))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / bandwidth, (k, width)), rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), np.array([0.0]), np.array([0.5]))

    def add_up(batches):
        total = np.zeros((width + 1, width + 2))
        for b in batches:
            z = model.features(np.array(b.column(1).to_pylist()).reshape(-1, k))
            total += z.T @ np.hstack([z, np.array(b.column(0).to_pylist(), float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    sums = sample.where("fold = 0").select("y", "x").mapInArrow(add_up, "sums array<double>").collect()
    total = sum((np.array(r["sums"]).reshape(width + 1, width + 2) for r in sums), np.zeros((width + 1, width + 2)))
    n = total[-1, width]
    if not n:
        return model
    model.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(width + 1), total[:, -1])
    held = sample.where("fold = 1").select("y", "x").toPandas()  # bounded by sample_rows
    if not len(held):
        held = sample.select("y", "x").toPandas()
    model.steps, model.levels = isotonic(model.features(np.stack(held["x"].to_list())) @ model.weights, held["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, *keep: str | Column, text_col: str = "text") -> DataFrame:
    """The columns `keep` of each row with score (0 to 1) and predicted (1 from 0.5 on)."""
    chosen = docs.select(*keep)

    def run(batches):
        for b in batches:
            s = model.score(_statistics_rows(b, b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*b.schema.names[:-1], "score", "predicted"])

    schema = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes)
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__raw")).mapInArrow(run, schema + ", score double, predicted int")
