"""Whitening of vectors by a covariance that comes from squares alone.

4 cov(a, b) = var(a + b) - var(a - b), and likewise 2 cov(a, b) = var(a + b) - var(a) - var(b): so sums of squared
centred values for every dimension and every sum of two dimensions give the whole matrix. Components become integers,
and those sums are taken exactly, so that they do not depend on how rows lie in partitions or in what order they come.

Semantics. A component c becomes floor(scale * c) + shift. Vectors that are null, empty, or hold null or non-finite
components take no part, nor do those of another length than the most frequent one (ties: the shorter). Vectors that
repeat count once in the fit and are whitened each; null and repeated ids are rows like any other. A component of no
variance has whitened values of 0. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import drop, written

LONG = 2**63
LIMIT = float(2**62)


def whole_vectors(df: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of floor(scale * c) + shift; components beyond a long are held at its ends."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * scale))
    rows = df.where(F.col(f"`{vector_col}`").isNotNull()).where((F.size(v) > 0) & ~bad)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(held(c)).cast("long") + shift).alias("x"))


def _rows(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _safe(x: np.ndarray, most: int) -> np.ndarray:
    """x as 64-bit integers where no value computed from it passes 2**62 (`most` bounds them), else as Python's."""
    return x if most < LONG // 2 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def squared_sums(y: np.ndarray) -> np.ndarray:
    """The sum over rows of (y_a + y_b)**2 for a < b and of y_a**2 for a = b, by pairs a <= b in order."""
    y = _safe(y, 4 * _largest(y) ** 2 * max(1, len(y)))
    out = []
    for a in range(y.shape[1]):
        out.append((y[:, a] * y[:, a]).sum())
        both = y[:, a : a + 1] + y[:, a + 1 :]
        out += (both * both).sum(axis=0).tolist()
    return np.array([int(v) for v in out], object)


@dataclasses.dataclass
class Whitening:
    """What is fitted: n vectors with sums by dimension, their covariance, and its components."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray  # a column for each
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> list[int]:
        """The mean, rounded: where integers are small but exact."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x - mean, projected on each component, over the root of its variance."""
        y = _off(x, self.centre)
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, self.centre, strict=True)])
        scale = np.array([v**-0.5 if v > 0 else 0.0 for v in self.values.tolist()])
        return (y.astype(np.float64) - rest) @ self.components * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)**2 for each row, exactly; null where it is beyond a long."""
        y = _off(x, self.centre)
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]
        most = self.n * _largest(y) + max(map(abs, rest), default=0)
        off = _safe(y, most * most * y.shape[1]) * self.n
        off = off - np.array(rest, off.dtype)
        return [v if v < LONG else None for v in map(int, (off * off).sum(axis=1).tolist())]


def _off(x: np.ndarray, centre: list[int]) -> np.ndarray:
    most = _largest(x) + max(map(abs, centre), default=0)
    x = _safe(x, most)
    return x - np.array(centre, x.dtype)


def _summed(fit: DataFrame, width: int, pairs: list[tuple[int, int]], of_rows, kind: str) -> dict[int, object]:
    """{place: sum over all rows} of what `of_rows` gives for a block of rows, added up by Spark.

    A task sends one number for each place, so what is shuffled and what the driver gets depend on the width alone.
    """
    exact = kind != "double"

    def run(batches):
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = of_rows(_rows(b.slice(at, 4096), 0, width))
                total = part if total is None else total + part
        if total is not None:
            # exact sums may be longer than any number type: they go in limbs of 30 bits, the last one signed
            for place, v in enumerate(total.tolist()):
                limbs = [v] if not exact else _limbs(v)
                names = ["place", "limb", "v"]
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(limbs), pa.int32()), pa.array(range(len(limbs)), pa.int32()), pa.array(limbs, pa.int64() if exact else pa.float64())], names)

    def packed(batches):
        found = list(run(batches))
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    parts = fit.select("x").mapInArrow(packed, f"place int, limb int, v {'bigint' if exact else 'double'}")
    out: dict[int, object] = dict.fromkeys(range(len(pairs)), 0)
    for r in parts.groupBy("place", "limb").agg(F.sum("v").alias("v")).collect():  # as many as pairs of dimensions
        out[r.place] += r.v * (1 << (30 * r.limb)) if exact else r.v  # type: ignore[operator]
    return out


def _limbs(v: int) -> list[int]:
    out = []
    while not -(1 << 30) < v < 1 << 30:
        out.append(v & ((1 << 30) - 1))
        v >>= 30
    return [*out, v]


def fit(x: DataFrame, width: int, components: int) -> Whitening:
    """From distinct vectors `x` (x array<long>) of one width. The driver gets sums by dimension and by pair of
    dimensions, and takes the eigenvectors of a matrix of `width` rows; the table stays where it lies."""
    n = x.count()
    places = [(a, a) for a in range(width)]
    by_dim = _summed(x, width, places, lambda m: np.array([int(v) for v in _safe(m, _largest(m) * max(1, len(m))).sum(axis=0).tolist()], object), "exact")
    fitted = Whitening(n, [int(by_dim[d]) for d in range(width)], np.zeros((width, width)), np.zeros((width, 0)), np.zeros(0), 0.0)
    centre = fitted.centre
    pairs = [(a, b) for a in range(width) for b in range(a, width)]
    found = _summed(x, width, pairs, lambda m: squared_sums(_off(m, centre)), "exact")
    # of x - centre to n x - S: sum (n y - r)**2 = n**2 sum y**2 - n r**2, where r = sum y
    rest = [s - n * c for s, c in zip(fitted.sums, centre, strict=True)]
    total = [0] * width
    square: dict[tuple[int, int], int] = {}
    for place, (a, b) in enumerate(pairs):
        r = rest[a] if a == b else rest[a] + rest[b]
        square[a, b] = n * n * int(found[place]) - n * r * r
        if a == b:
            total[a] = square[a, a]
    for a, b in pairs:
        twice = 2 * square[a, a] if a == b else square[a, b] - total[a] - total[b]
        fitted.covariance[a, b] = fitted.covariance[b, a] = float(Fraction(twice, 2 * n**3))
    values, vectors = np.linalg.eigh(fitted.covariance)
    kept = np.argsort(-values, kind="stable")[:components]
    fitted.values, fitted.components = values[kept], vectors[:, kept]
    fitted.trace = float(Fraction(sum(total), n**3))
    noise = np.finfo(float).eps * width * max(float(values.max(initial=0.0)), 0.0)
    fitted.values = np.where(fitted.values > noise, fitted.values, 0.0)
    fitted.identity_error = _identity_error(x, width, fitted)
    return fitted


def _identity_error(x: DataFrame, width: int, fitted: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity."""
    m = len(fitted.values)
    places = [(a, b) for a in range(m + 1) for b in range(m + 1)]

    def sums(rows: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(rows)), fitted.whitened(rows)])
        return (w.T @ w).ravel()

    s = np.array(list(_summed(x, width, places, sums, "double").values()), float).reshape(m + 1, m + 1)
    mean = s[0, 1:] / fitted.n
    return float(np.abs(s[1:, 1:] / fitted.n - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and each of the first `components` components, those of largest variance first.

    The distinct vectors, which are fitted, are written once and read for the sums, the squares and the check of the
    result. Equal vectors meet in partial aggregates before the shuffle, so a vector that fills a third of the table
    is a row of each task there.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, shift, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    width = int(lengths[0].width)
    rows = rows.where(F.size("x") == width)
    distinct = written(rows.select("x").distinct(), "fit-vectors")
    fitted = fit(distinct, width, components)
    drop(distinct)
    explained = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(len(fitted.values))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        m = len(fitted.values)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _rows(part, 1, width)
                k = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(k), m)))
                deviation = pa.array(fitted.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), m)))
                columns = [ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, fitted.n)), deviation, pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, fitted.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("id", "x").mapInArrow(run, SCHEMA)
