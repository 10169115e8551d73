"""Embedding whitening: principal components by block Lanczos, without the covariance matrix.

1. Vectors become integers, floor(256 * entry), packed into bytes; the distinct ones are
   the fit list, a stored table. Copies are folded in each task before the shuffle.
2. Sums of the fit list are exact; `n` times a vector less the sums, squared and
   added up in integers, is a vector's deviation, and all deviations give the trace.
3. Block Lanczos: each step multiplies the centred vectors with a thin block of
   directions, X'(X Q), in one pass over the fit list. A task gives one row for each
   dimension, which Spark adds up, so no d x d matrix is made or moved. The driver
   holds the basis only (d x steps * block). New directions are orthogonalised twice
   against the whole basis; a block that breaks down gets fresh random directions,
   so that also repeated eigenvalues are found. It ends when the residuals of the leading
   pairs are at rounding level, or when the basis spans the whole space.
4. One more pass measures the covariance of the whitened vectors against the identity.

Rows with a null vector or a null or non-finite entry are left out, and so are those
whose length isn't the most frequent one (of equals the longer): they have no
covariance with the others. Components without variance (below `RANK` of the first)
can't be scaled to one and are left out; a single distinct vector has none. Entries
beyond 2**54 count as 2**54. A deviation beyond 64 bits is null in the query. A
null id stays null; repeated rows give repeated results; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, stored

#: Variance under this share of the largest is rounding.
RANK = 1e-12
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, d, x): the integers of each usable vector as bytes, in the narrowest type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            column = batch.column(1)
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), -1)
            values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(sizes, 0))
            keep, lengths, data = [], [], []
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                block = values[(ends[rows] - size)[:, None] + np.arange(size)]
                good = np.isfinite(block).all(1)
                rows, block = rows[good], np.clip(np.floor(256 * block[good]), -(2.0**62), 2.0**62).astype(np.int64)
                low, high = block.min(1), block.max(1)
                width = sum((low < np.iinfo(w).min) | (high > np.iinfo(w).max) for w in WIDTHS[:3])
                for w, kind in enumerate(WIDTHS):
                    mine = rows[width == w]
                    keep += mine.tolist()
                    lengths += [size] * len(mine)
                    data += [bytes([w]) + x.tobytes() for x in block[width == w].astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(lengths, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "d", "x"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, d int, x binary")


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The integer vectors of a column of packed ones, as rows."""
    data = column.to_pylist()
    out = np.zeros((len(data), d), np.int64)
    width = np.array([b[0] for b in data], np.int64)
    for w, kind in enumerate(WIDTHS):
        mine = np.flatnonzero(width == w)
        if len(mine):
            out[mine] = np.frombuffer(b"".join(data[i][1:] for i in mine.tolist()), kind).reshape(-1, d)
    return out


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """`x` as it is where sums and products up to `most` fit 64 bits, else as Python's integers."""
    return x if most < 2**63 else x.astype(object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sums)**2 of each row, exact: n**2 x.x - 2 n x.sums + sums.sums."""
    if not len(x):
        return []
    most, far, d = int(np.abs(x).max()), max(map(abs, sums)), x.shape[1]
    squares = _exact(x, d * most * most)
    squares = (squares * squares).sum(1).tolist()
    wide = d * most * far >= 2**63
    cross = (x.astype(object) if wide else x) @ np.array(sums, object if wide else np.int64)
    own = sum(s * s for s in sums)
    return [n * n * a - 2 * n * b + own for a, b in zip(squares, cross.tolist())]


@dataclass
class Fit:
    """What the fit list is like: its vectors are rows of a stored table."""

    rows: DataFrame
    d: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def added(self, each, columns: int, at_end=None) -> np.ndarray:
        """The sum over all tasks of `each`(integer rows), a matrix of few rows; Spark adds the tasks' rows up."""
        d = self.d
        names = [f"v{j}" for j in range(columns)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = each(unpacked(batch.column(0).slice(at, 4096), d))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["i", *names])

        schema = "i int, " + ", ".join(f"{x} double" for x in names)
        out = self.rows.select("x").mapInArrow(run, schema).groupBy("i").agg(*(F.sum(x).alias(x) for x in names)).toArrow().sort_by("i")
        return np.stack([out.column(x).to_numpy() for x in names], 1)

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times some directions: centred first, then multiplied, in one pass."""
        mean, n = self.mean, self.n

        def each(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return self.added(each, block.shape[1]) / n

    def trace(self) -> float:
        """The covariance's trace, from the deviations of all rows."""
        n, sums = self.n, self.sums
        return float(self.added(lambda x: np.array([[float(sum(deviations(x, n, sums)))]]), 1)[0, 0]) / float(n) ** 3


def fit_list(vectors: DataFrame) -> tuple[DataFrame, Fit | None]:
    """(usable rows as packed, the fit list); None where no row is usable."""
    rows = stored(packed(vectors), "whitening-rows")
    lengths = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows, None
    d = lengths["d"]
    rows = rows.where(F.col("d") == d)
    distinct = stored(rows.select("x").distinct(), "whitening-fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = unpacked(batch.column(0), d)
            n += len(x)
            total = total + _exact(x, len(x) * int(max(x.max(initial=0), -x.min(initial=0)))).sum(0)
        values = [int(v) for v in total] + [n]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array([str(v) for v in values])], ["i", "s"])

    sums = distinct.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    values = [int(r["s"]) for r in sums]
    return rows, Fit(distinct, d, values[-1], values[:-1])


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, random: np.random.Generator) -> np.ndarray:
    """Orthonormal directions of a block that are orthogonal to the basis; columns that depend on others give way to fresh random ones."""
    out = basis
    room = min(block.shape[1], basis.shape[0] - basis.shape[1])
    for column in block.T:
        if out.shape[1] - basis.shape[1] == room:
            break
        least = 1e-10 * scale
        while True:
            for _ in range(2):
                column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size > least:
                break
            column, least = random.standard_normal(len(column)), 1e-6
        column = column / size
        column = column - out @ (out.T @ column)
        out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, basis.shape[1] :]


def lanczos(product, d: int, k: int, width: int = 8, tolerance: float = 1e-14, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns): the min(k, d) leading pairs of a symmetric operator of size d.

    `product` gives the operator times a block. The projection onto the basis is
    kept whole (basis' A basis), as full reorthogonalisation makes it as exact as a
    three-term recurrence and a restart leaves no gap in it.
    """
    k = min(k, d)
    width = min(d, max(width, k))
    random = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    block, scale = random.standard_normal((d, width)), 1.0
    while True:
        fresh = _orthonormal(block, basis, scale, random)
        image = product(fresh)
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        vectors = basis @ turns
        scale = max(float(abs(values).max()), np.finfo(float).tiny)
        residuals = np.linalg.norm(images @ turns - vectors * values, axis=0)
        if basis.shape[1] == d or basis.shape[1] >= 2 * k and (residuals <= tolerance * scale * np.sqrt(d)).all():
            return values, vectors / np.linalg.norm(vectors, axis=0)
        block = image


def whiten(vectors: DataFrame, k: int = 4, width: int = 8) -> DataFrame:
    """RESULT for each usable row and each of the k leading components."""
    rows, fit = fit_list(vectors)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    values, directions = lanczos(fit.product, fit.d, k, width)
    some = (values > 0) & (values > RANK * values[0])
    values, directions = values[some], directions[:, some]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], RESULT)
    d, n, sums, mean, scaled = fit.d, fit.n, fit.sums, fit.mean, directions / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled
        return np.vstack([y.T @ y, y.sum(0)])

    totals = fit.added(moments, len(values)) / n
    error = float(np.abs(totals[:-1] - np.outer(totals[-1], totals[-1]) - np.eye(len(values))).max())
    explained = values / fit.trace()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = unpacked(part.column(1), d)
                many = len(values)
                rows = np.repeat(np.arange(len(x)), many)
                columns = [
                    part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, many + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), n), pa.int64()),
                    pa.array(list(map(str, deviations(x, n, sums)))).take(pa.array(rows)), pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [c.split()[0] for c in RESULT.split(", ")]
    out = rows.select("vec_id", "x").mapInArrow(run, RESULT.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
