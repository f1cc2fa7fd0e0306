"""Whitening of embeddings by shifted Cholesky QR.

The centred rows Y are never gathered. Each pass sends one Gram matrix a
partition, as the cells of its upper triangle, which Spark adds up:

    G1 = Y'Y               R1 = chol(G1 + shift * I)
    G2 = Q1'Q1             R2 = chol(G2)               Q1 = Y R1^-1
    G3 = Q2'Q2             R3 = chol(G3)               Q2 = Q1 R2^-1

The shift keeps the first factor from breaking down, the next passes repair
what it and the rounding of G1 have cost. With R = R3 R2 R1 and orthonormal Q,
Y = Q R, so the SVD of the small R gives the components and their variances
without the squared condition number of Y'Y. Directions without variance stay
zero in Q; there the last factor is the root of G3 from its eigenvalues.

Rows are read once a pass and never shuffled; what reaches the driver has the
size of the dimension squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, BASE = 1024, 100_000  # an entry c becomes the integer floor(SCALE * c) + BASE
LARGEST = 2.0 ** 62
UNIT = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with exact sums ``sums`` a dimension; ``axes``: unit components in columns, by falling ``variances``."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def rank(self) -> int:
        """Components whose variance is more than rounding."""
        if not len(self.variances) or self.variances[0] <= 0:
            return 0
        return int((self.variances > self.variances[0] * (64 * len(self.sums) * UNIT) ** 2).sum())


def _finite(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite and within 62 bits once scaled."""
    inside = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(inside, F.lit(False))


def usable(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part, ids as given and entries as doubles.

    Null and empty vectors go, and those with null, non-finite or unscalable
    entries. If lengths differ, the most frequent one counts (of equally
    frequent ones the longest); vectors of other lengths go.
    """
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(_finite(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (lengths["d"] if lengths else 0))


def _integers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE).astype(np.int64) + BASE).reshape(len(column), -1)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they hold it, else as Python integers."""
    high = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1)
    if 2 * high * n < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of each dimension."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column("vector"))
                exact = x if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object)
                n, total = n + len(x), total + exact.sum(axis=0).astype(object)
        if n:
            cells = [Decimal(n), *(Decimal(int(v)) for v in total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.decimal128(38, 0))], names=["cell", "value"])

    held = rows.select("vector").mapInArrow(work, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = {r["cell"]: int(r["value"]) for r in held.collect()}  # one row a dimension
    return cells.get(0, 0), tuple(cells[k] for k in sorted(cells) if k)


def _gram(rows: DataFrame, size: int, image: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of z'z over all rows, z being their image; one matrix a partition is sent."""
    upper = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = image(_integers(batch.column("vector")))
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["cell", "value"])

    held = rows.select("vector").mapInArrow(work, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros((size, size))
    for r in held.collect():  # one row a cell of the triangle
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        out[i, j] = out[j, i] = r["value"]
    return out


def _solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """y R^-1 for R = ... R2 R1, one triangular factor after the other."""
    for r in factors:
        y = np.linalg.solve(r.T, y.T).T
    return y


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper triangular factor of a Gram matrix: shifted in the first pass, later one where a direction is empty."""
    d = len(gram)
    if first:
        gram = gram + 11 * (n * d + d * (d + 1)) * UNIT * np.linalg.norm(gram, 2) * np.eye(d)
    else:
        values, vectors = np.linalg.eigh(gram)
        empty = vectors[:, values <= 64 * d * UNIT * values[-1]]
        gram = gram + empty @ empty.T
    return np.linalg.cholesky(gram).T


def fit_whitening(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", passes: int = 3) -> Whitening:
    """Components and variances of all usable rows; ``df`` must give the same rows at each of ``passes`` + 2 reads.

    Without rows all parts are empty; with one row, or equal ones, the
    variances are zero.
    """
    rows = usable(df, id=id, vector=vector)
    n, sums = _sums(rows)
    d = len(sums)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for k in range(passes):
        held = list(factors)
        gram = _gram(rows, d, lambda x: _solved(_centred(x, n, sums), held))
        if not gram.any():
            return Whitening(n, sums, np.eye(d), np.zeros(d), 0.0)
        if k + 1 < passes:
            factors.append(_factor(gram, n, first=not k))
            composed = factors[-1] @ composed
            continue
        values, vectors = np.linalg.eigh(gram)
        whole = values[0] > 0.5
        last = np.linalg.cholesky(gram).T if whole else np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
        composed = last @ composed
    _, singular, axes = np.linalg.svd(composed)
    variances = singular ** 2 / n
    return Whitening(n, sums, axes.T, variances, float(variances.sum()))


def _scaled(model: Whitening, components: int) -> np.ndarray:
    """The columns that turn a centred row into its whitened components; not a number where there is no variance."""
    k = min(components, len(model.sums))
    inside = np.arange(k) < model.rank
    return model.axes[:, :k] / np.sqrt(np.where(inside, model.variances[:k], np.nan))


def identity_error(df: DataFrame, model: Whitening, *, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> float | None:
    """The largest absolute entry of the whitened covariance minus the identity, measured in one more pass."""
    k = min(components, model.rank)
    if not k:
        return None
    scaled, n, sums = _scaled(model, k), model.n, model.sums

    def image(x: np.ndarray) -> np.ndarray:
        return np.hstack([_centred(x, n, sums) @ scaled, np.ones((len(x), 1))])

    gram = _gram(usable(df, id=id, vector=vector), k + 1, image) / n
    covariance = gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, *, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained: a row for each usable row and component.

    ``deviation`` is the exact sum of (n * x - S)^2, a decimal of 38 digits, and
    the same for all components of a row. Components beyond the rank have null
    ``whitened`` and ``explained`` 0 (null if there is no variance at all).
    Repeated rows and ids are kept, null ids too; other columns are not returned.
    """
    rows = usable(df, id=id, vector=vector)
    n, sums, rank, k = model.n, model.sums, model.rank, min(components, len(model.sums))
    scaled = _scaled(model, components)
    shares = [model.variances[i] / model.total if i < rank else 0.0 for i in range(k)] if model.total > 0 else [None] * k
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _integers(batch.column("vector"))
            off = _deviations(x, n, sums)
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] >= 1 << 63:
                off = off.astype(object)
            deviation = [Decimal(int(v)) for v in (off * off).sum(axis=1)]
            z = _centred(x, n, sums) @ scaled
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(deviation, pa.decimal128(38, 0)).take(rows_of), pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                pa.array(shares * len(x), pa.float64())], names=["id", "component", "deviation", "whitened", "explained"])

    out = rows.mapInArrow(work, f"id {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return out.select(F.col("id").alias(id), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained")
