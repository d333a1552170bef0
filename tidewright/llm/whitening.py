"""Embedding whitening by matrix-free block Lanczos.

The covariance is never formed: each step is a pass over the distinct vectors
that centres them, multiplies a thin block by X and then by X transposed, and
adds up a matrix of dimensions x block size. The basis is kept fully
orthogonal on the driver; columns in which a block breaks down start anew at
random. The search ends when the residuals of all wanted components are small,
or when the basis spans the whole space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import scratch
from tidewright.session import ship_package

#: Residual of a component, as a part of the largest eigenvalue, from which it counts as found.
TOLERANCE = 1e-13
#: Eigenvalues up to this part of the largest are zero in double precision: such components can't be scaled to one.
RANK = 1e-10
# How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries are held to this magnitude, so that they and their sums stay exact.
BOUND = 1 << 52
#: Rows of a matrix that a task holds at once.
ROWS = 8192


class Whitening(NamedTuple):
    """Fitted components: of n vectors with sums S, unit eigenvectors in columns by falling eigenvalue, the trace, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a vector that is null, empty or holds a null or a non-finite entry."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))
    return F.when((F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda c: F.floor(held(c)) + SHIFT))


def rows_of(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, x) of the rows with a whole vector."""
    return df.select(F.col(row_id).alias("id"), whole_numbers(F.col(vector)).alias("x")).where("x IS NOT NULL")


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their vectors as an integer matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.asarray(part.column("x").flatten()).reshape(-1, dim)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n in double precision: n x - S is exact before the division."""
    if abs(n) * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(float)


def added(rows: DataFrame, dim: int, height: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(x): height x width numbers, added up in tasks first and then row by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for _, x in matrices(batches, dim):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select("x").mapInArrow(run, "i int, v array<double>")
    found = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v")).collect()
    out = np.zeros((height, width))
    for row in found:
        out[row.i] = row.v
    return out


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int, seed: int = 7, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` largest eigenvalues of a symmetric operator, their unit vectors in columns, and the passes made.

    Each pass multiplies `block` orthonormal columns; what is new in the
    product, made orthogonal to the whole basis twice, is the next block. The
    space of one start may lack further vectors of an eigenvalue that occurs
    several times, so after small residuals a random block has to bring
    nothing larger.
    """
    rng = np.random.default_rng(seed)
    basis, image, passes = np.zeros((dim, 0)), np.zeros((dim, 0)), 0

    def fresh(candidates: np.ndarray, size: int) -> np.ndarray:
        """`size` orthonormal columns, orthogonal to the basis: from the candidates, and random ones where those break down."""
        out = basis
        for k in range(size):
            given = k < candidates.shape[1]
            column, least = (candidates[:, k], floor) if given else (rng.standard_normal(dim), 0.0)
            while True:
                before = np.linalg.norm(column)
                for _ in range(2):
                    column = column - out @ (out.T @ column)
                after = np.linalg.norm(column)
                if after > least and after > 1e-10 * before:
                    break
                column, least = rng.standard_normal(dim), 0.0
            out = np.column_stack((out, column / after))
        return out[:, basis.shape[1] :]

    floor, held = 0.0, np.zeros(0)
    new = fresh(rng.standard_normal((dim, min(block, dim))), min(block, dim))
    while True:
        product = multiply(new)
        passes += 1
        basis, image = np.column_stack((basis, new)), np.column_stack((image, product))
        projected = basis.T @ image
        values, turns = np.linalg.eigh((projected + projected.T) / 2)
        values, turns = values[::-1][:wanted], turns[:, ::-1][:, :wanted]
        residual = np.linalg.norm(image @ turns - basis @ turns * values, axis=0)
        top = max(float(values[0]), 0.0)
        size = min(block, dim - basis.shape[1])
        small = basis.shape[1] >= wanted and residual.max() <= tolerance * top
        if not size or (small and len(held) and np.abs(values - held).max() <= tolerance * top):
            vectors = basis @ turns
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        floor = 1e-12 * top  # what is left of a product that lies in the basis is rounding
        held = values if small else held[:0]
        new = fresh(product[:, :0] if small else product, size)


def fit(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = 16, block: int = 16) -> Whitening | None:
    """Components of the distinct vectors of df; None if no row has a vector.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out, and so are vectors that have not the most frequent length (of
    equally frequent ones the longest). Rows that repeat count once. There are
    as many components as wanted, as the dimensions, or as eigenvalues above
    zero (RANK), whatever is least: one vector alone has none. The driver holds
    matrices of dimensions x dimensions at most.
    """
    ship_package(df.sparkSession)
    rows = rows_of(df, row_id, vector)
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim = lengths.dim
    # equal vectors are one row before they are shuffled
    distinct = scratch.table(rows.where(F.size("x") == dim).select("x").distinct(), "distinct-vectors")
    n = distinct.count()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for _, x in matrices(batches, dim):
            total += x.sum(0) if np.abs(x).max(initial=0) < 1 << 49 else x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    sums = np.zeros(dim, object)
    for row in distinct.mapInArrow(totals, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[row.i] = int(row.s)

    def multiply(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ columns)

        return added(distinct, dim, dim, columns.shape[1], part) / n

    wanted = min(components, dim)
    values, vectors, _ = lanczos(multiply, dim, wanted, block)
    kept = values > RANK * max(float(values[0]), 0.0)
    values, vectors = values[kept], vectors[:, kept]
    # either sign is right: the largest entry is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    k = len(values)

    def checks(x: np.ndarray) -> np.ndarray:
        """Of whitened rows the products, the sums, and the squared deviations."""
        c = centred(x, n, sums)
        y = c @ (vectors / np.sqrt(values))
        return np.vstack((y.T @ y, y.sum(0), np.full(k, (c * c).sum())))[:, :k] if k else np.full((2, 1), (c * c).sum())

    found = added(distinct, dim, k + 2, max(k, 1), checks) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max()) if k else 0.0
    return Whitening(n, sums, vectors, values, float(found[k + 1, 0]), error)


def apply(df: DataFrame, whitening: Whitening | None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of the rows with a whole vector of the fitted length, repeated rows each.

    deviation is the exact sum of (n x - S)^2, null where it has more than 38
    digits; whitened holds a number for each component. A null id stays; other
    columns are ignored.
    """
    ship_package(df.sparkSession)
    rows = rows_of(df, row_id, vector)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{row_id}` {kind}, deviation decimal(38,0), whitened array<double>"
    if whitening is None:
        return rows.where("false").select(F.col("id").alias(row_id), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    n, sums, vectors, values = whitening[:4]
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, dim):
            y = centred(x, n, sums) @ (vectors / np.sqrt(values))
            large = n * (int(np.abs(x).max(initial=0)) + 1)
            off = n * x - sums.astype(np.int64) if large < 1 << 62 else n * x.astype(object) - sums
            # whole numbers of 64 bits hold the sum of squares where its estimate is well below their bound
            if off.dtype == object or (off.astype(float) ** 2).sum(1).max(initial=0) >= 2.0**62:
                off = off.astype(object)
            deviation = [Decimal(d) if d < 10**38 else None for d in map(int, (off * off).sum(1))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(y), pa.list_(pa.float64()))], [row_id, "deviation", "whitened"])

    return rows.where(F.size("x") == dim).mapInArrow(run, schema)


def long_form(whitened: DataFrame, whitening: Whitening | None) -> DataFrame:
    """A row for each row of apply() and component (from 1): deviation as a long (null where it doesn't fit), the whitened number, n, and the explained share."""
    n, shares, error = (whitening.n, (whitening.values / whitening.trace).tolist(), whitening.identity_error) if whitening else (0, [], 0.0)
    each = whitened.select("*", F.posexplode("whitened").alias("__k", "__y"))
    share = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("__k"))
    return each.select(
        *[c for c in whitened.columns if c not in ("deviation", "whitened")],
        (F.col("__k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("__y").alias("whitened"),
        share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
