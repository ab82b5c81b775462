"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Components become integers x = floor(scale * c) + offset. The fit list holds each different x vector once, packed in
blocks of rows and written to the shared folder. One step of the bidiagonalisation is one Spark job over those blocks:
every task multiplies its centred rows by a vector (Xv) and the outcome by its rows again (X'u), and the partial sums
are added by Spark. Left vectors stay where the rows are: each is X times a short coefficient vector, and their inner
products with a new vector follow from X'u, so full reorthogonalisation on both sides needs no further pass and the
driver holds square matrices of the dimension only. After as many steps as there are dimensions the small bidiagonal
matrix has the singular values of the rows; its singular vectors give components to double precision. Where a step
finds nothing new (repeated values, fewer rows than dimensions) it goes on from another direction.

Cases: vectors that are null or hold null or non-finite entries are dropped; so are vectors whose length is not the
most common one (the smaller of equally common lengths counts), since one covariance needs one dimension. Rows without
a key are whitened like others, repeated rows each. Entries beyond 2^50 after scaling count as 2^50. A deviation that
no long holds is null. Components of no variance (up to rounding) are left out, so equal vectors, a single vector and
an empty table give no rows. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise

BLOCK_ROWS = 4096
FARTHEST = float(1 << 50)
NOTHING = 1e-13  # of the largest length met: a step that leaves less has found nothing new
LEAST = 1e-11  # of the first singular value: smaller ones are rounding


def _integers(column: Column, scale: float, offset: int) -> Column:
    return F.transform(column, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(FARTHEST)), F.lit(-FARTHEST))) + offset)


def integer_rows(vectors: DataFrame, key: str, column: str, scale: float, offset: int) -> DataFrame:
    """id, x of every row whose vector is whole and finite."""
    finite = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(F.col(column).isNotNull() & finite).select(F.col(key).cast("bigint").alias("id"), _integers(F.col(column), scale, offset).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class FitList:
    """Blocks of different vectors (`x` bytes of longs), how many vectors, and the exact sum of each dimension."""

    blocks: DataFrame
    dims: int
    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        """The mean's nearest integers; rows less these are exact."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - self.n * int(w)) / self.n for s, w in zip(self.sums, self.whole, strict=True)])

    def summed(self, of_rows: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """of_rows(centred rows) gives `size` numbers; added over all rows, in tasks first, then over a shuffle."""
        dims, whole, rest = self.dims, self.whole, self.rest

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for x in batch.column(0):
                    total += of_rows((np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dims) - whole) - rest)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "part"])

        out = np.zeros(size)
        for place, total in self.blocks.mapInArrow(work, "place bigint, part double").groupBy("place").agg(F.sum("part")).collect():
            out[place] = total
        return out


def fit_list(rows: DataFrame) -> FitList | None:
    """Each different x once; None if there is no vector."""
    usual = rows.groupBy(F.size("x").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return None
    dims = usual["dims"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column(0).slice(at, BLOCK_ROWS), dims)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))], names=["x", "n", "sums"])

    blocks = materialise(rows.filter(F.size("x") == dims).select("x").distinct().mapInArrow(packed, "x binary, n bigint, sums array<bigint>"), "whitening-fit")
    sums = {r["place"]: int(r["s"]) for r in blocks.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return FitList(blocks.select("x"), dims, blocks.agg(F.sum("n")).first()[0], [sums[k] for k in range(dims)])


@dataclass
class Bidiagonal:
    """X v = u b: right vectors (columns), diagonal, and what stands above it."""

    v: np.ndarray
    diagonal: list[float]
    above: list[float]

    def singular(self) -> tuple[np.ndarray, np.ndarray]:
        """Singular values, falling, and right singular vectors (columns) of the rows."""
        small = np.diag(self.diagonal) + np.diag(self.above[: len(self.diagonal) - 1], 1)
        _, values, right = np.linalg.svd(small)
        return values, self.v[:, : len(values)] @ right.T


def _apart(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """p without its part in the columns of v, taken off twice since the first leaves rounding."""
    for _ in range(2):
        p = p - v @ (v.T @ p)
    return p


def bidiagonalise(products: Callable[[np.ndarray], tuple[np.ndarray, float]], dims: int, wanted: int, tolerance: float, seed: int) -> Bidiagonal:
    """`products(z)` gives X'Xz as one alternating pass (X z, then X' of it) and |Xz|^2. Runs through all dimensions, or
    until the residuals of the first `wanted` singular triplets are below `tolerance` times the first value (a value
    that occurs twice may then be found once; with tolerance 0 all are found)."""
    rng = np.random.default_rng(seed)
    v = np.zeros((dims, 0))
    c, g = np.zeros((dims, 0)), np.zeros((dims, 0))  # u = X c, and X'u
    diagonal, above, largest = [], [], 0.0
    following = rng.standard_normal(dims)
    for step in range(dims):
        v = np.column_stack([v, following / np.linalg.norm(following)])
        z = v[:, -1] - (above[-1] * c[:, -1] if step else 0)
        pull, squared = products(z)
        for _ in range(2):
            with_u = c.T @ pull
            z, pull, squared = z - c @ with_u, pull - g @ with_u, squared - with_u @ with_u
        alpha = float(np.sqrt(max(squared, 0.0)))
        largest = max(largest, alpha)
        if alpha <= NOTHING * largest:
            alpha, z, pull = 0.0, np.zeros(dims), np.zeros(dims)
        diagonal.append(alpha)
        c = np.column_stack([c, z / alpha if alpha else z])
        g = np.column_stack([g, pull / alpha if alpha else pull])
        following = _apart(g[:, -1] - alpha * v[:, -1], v)
        beta = float(np.linalg.norm(following))
        largest = max(largest, beta)
        if beta <= NOTHING * largest:
            beta, following = 0.0, _apart(rng.standard_normal(dims), v)
        above.append(beta)
        if tolerance and step + 1 >= min(wanted, dims):
            left, values, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above[:-1], 1))
            if np.all(beta * np.abs(left[-1, :wanted]) <= tolerance * values[0]):
                break
    return Bidiagonal(v, diagonal, above)


@dataclass
class Whitening:
    """What is needed to whiten a row, and the figures of the fit."""

    fit: FitList
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def fitted(rows: DataFrame, wanted: int = 16, tolerance: float = 0.0, seed: int = 11) -> Whitening | None:
    """Whitening of integer rows (id, x); None where no direction has any variance."""
    fit = fit_list(rows)
    if fit is None:
        return None
    dims, n = fit.dims, fit.n
    spread = fit.summed(lambda x: np.append(x.sum(axis=0), np.einsum("ij,ij->", x, x)), dims + 1)
    left_over, total = spread[:dims] / n, spread[dims]
    if not total:
        return None

    def products(z: np.ndarray) -> tuple[np.ndarray, float]:
        def of_rows(x: np.ndarray) -> np.ndarray:
            u = x @ z
            return np.append(u @ x, u @ u)

        out = fit.summed(of_rows, dims + 1)
        return out[:dims], float(out[dims])

    values, vectors = bidiagonalise(products, dims, wanted, tolerance, seed).singular()
    kept = int(np.sum(values[:wanted] > LEAST * values[0]))
    components, variances = vectors[:, :kept], values[:kept] ** 2 / n
    to_white = components / np.sqrt(variances)
    middle = left_over @ to_white

    def crossed(x: np.ndarray) -> np.ndarray:
        y = x @ to_white - middle
        return (y.T @ y).ravel()

    covariance = fit.summed(crossed, kept * kept).reshape(kept, kept) / n
    return Whitening(fit, components, variances, variances * n / total, float(np.abs(covariance - np.eye(kept)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum over dimensions of (n * x - sum)^2, exact; null where no long holds it."""
    farthest = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True)), default=0)
    if farthest * farthest * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        y = x * n - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


RESULT = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, wanted: int = 16, key: str = "vec_id", column: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, tolerance: float = 0.0) -> DataFrame:
    """A row per vector and component (from 1, by falling variance), after a fit over the same table."""
    rows = integer_rows(vectors, key, column, scale, offset)
    w = fitted(rows, wanted, tolerance)
    if w is None:
        return vectors.sparkSession.createDataFrame([], RESULT).withColumnRenamed("id", key)
    dims, n, sums, whole, rest = w.fit.dims, w.fit.n, w.fit.sums, w.fit.whole, w.fit.rest
    to_white, explained, error = w.components / np.sqrt(w.variances), w.explained, w.identity_error
    k = len(explained)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                few = batch.slice(at, BLOCK_ROWS)
                x = matrix(few.column(1), dims)
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    few.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array((((x - whole) - rest) @ to_white).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == dims).mapInArrow(work, RESULT).withColumnRenamed("id", key)
