"""Whitening of embeddings along their leading principal components, by Jacobi-Davidson.

Entries become whole numbers, floor(64 * c) + 1000000. Each distinct vector counts once: they
are the fit list, whose sums are exact. The covariance is never formed. All that is asked of
it are products with a few vectors at a time: one pass over the stored fit list, in which each
task centres its rows exactly (n * x - S in whole numbers, rounded once), multiplies and adds
up, and a tree of tasks adds the partial products.

On these products works a block Jacobi-Davidson iteration. The leading Ritz pairs of a small
search space are taken (Rayleigh-Ritz); for those that are not settled yet the projected
correction equations (I - QQ')(V - theta I)(I - QQ') t = -r are solved by some steps of MINRES,
all of them in step, so that one pass serves all equations; the corrections widen the space.
A pair whose residual is down to rounding is locked, and everything after is kept orthogonal to
it. Once all are locked, a last Rayleigh-Ritz on a fresh product settles them together.

Defined results: a vector that is null or holds null or non-finite entries takes no part. A
shorter vector counts as if zeros followed (an empty one is all zeros). Entries whose whole
number passes 2**62 are held there. Repeated rows and rows without vec_id are rows of the
result, but a vector counts once in the fit. Components without variance (to rounding) are left
out, for nothing can be divided by it: fewer vectors than components give fewer of them, one
distinct vector or an empty table none. Of an eigenvector, the entry of largest size is
positive. Equal eigenvalues share a space in which any basis is right. A deviation beyond 64
bits is null. Other columns are ignored.

Bounds: the driver holds some hundred vectors of the embedding's width, and gets per product as
many partial sums as the square root of the tasks, 64 at least.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.scratch import stored

COMPONENTS = 16
# Fixed values of the whole-number form.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 62
#: Vectors sought beyond those wanted, MINRES steps per correction, and search space in blocks.
GUARD, STEPS, SPACE = 4, 6, 4
#: Outer iterations after which the search has failed.
ROUNDS = 200
#: Partial sums that the driver adds itself; more of them are added by tasks first.
FEW = 64

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- the iteration; `product` is all it knows of the matrix


def _orthonormal(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to orthonormal bases."""
    for _ in range(2):
        for basis in bases:
            block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        left, sizes, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, sizes > 1e-10 * sizes[0]]
    return block


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of apply(x) = right, a column each, by MINRES in step.

    `apply` is symmetric in every column. A column whose residual is gone stands still.
    """
    size = lambda block: np.sqrt((block * block).sum(axis=0))
    safe = lambda values: np.where(values > 0, values, 1.0)
    x, w, w_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    before, now = np.zeros_like(right), right
    beta_before, beta = np.ones(right.shape[1]), size(right)
    rest, start = beta.copy(), beta.copy()
    cosine, sine = -np.ones_like(beta), np.zeros_like(beta)
    delta_bar, epsilon = np.zeros_like(beta), np.zeros_like(beta)
    for step in range(steps):
        going = beta > 1e-15 * safe(start)
        if not going.any():
            break
        # Lanczos
        v = np.where(going, now / safe(beta), 0.0)
        image = apply(v)
        if step:
            image = image - before * (beta / safe(beta_before))
        alpha = (v * image).sum(axis=0)
        image = image - now * (alpha / safe(beta))
        before, now = now, image
        beta_before, beta = beta, size(image)
        # the new column of the tridiagonal matrix under the rotations so far, and the next one
        delta, gamma_bar = cosine * delta_bar + sine * alpha, sine * delta_bar - cosine * alpha
        epsilon_before, epsilon, delta_bar = epsilon, sine * beta, -cosine * beta
        gamma = np.hypot(gamma_bar, beta)
        cosine, sine = np.where(gamma > 0, gamma_bar / safe(gamma), 1.0), np.where(gamma > 0, beta / safe(gamma), 0.0)
        w_before, w = w, np.where(going & (gamma > 0), (v - epsilon_before * w_before - delta * w) / safe(gamma), 0.0)
        x = x + w * (cosine * rest)
        rest = sine * rest
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, of a positive semidefinite matrix, and its unit eigenvectors.

    All residuals are within rounding of the largest eigenvalue when it returns.
    """
    count = min(count, size)
    block = min(size, count + GUARD)
    locked = np.zeros((size, 0))
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    new, scale = np.random.default_rng(11).standard_normal((size, block)), 0.0
    for _ in range(ROUNDS):
        new = _orthonormal(new, locked, basis)
        if not new.shape[1]:
            # nothing left to search along: another start
            new = _orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((size, block)), locked, basis)
        basis, images = np.hstack([basis, new]), np.hstack([images, product(new)]) if new.shape[1] else images
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        scale = max(scale, values[0])
        residual = images - basis * values
        residual -= locked @ (locked.T @ residual)
        far = np.linalg.norm(residual, axis=0) > 8 * math.sqrt(size) * np.finfo(float).eps * scale
        whole = basis.shape[1] + locked.shape[1] >= size
        # from the top, in order; a space that is all there is has exact pairs
        settled = min(count - locked.shape[1], len(far) if whole or not far.any() else int(np.argmax(far)))
        locked = _orthonormal_add(locked, basis[:, :settled])
        if locked.shape[1] >= count:
            break
        basis, images, values, residual, far = basis[:, settled:], images[:, settled:], values[settled:], residual[:, settled:], far[settled:]
        if basis.shape[1] > (SPACE - 1) * block:
            basis, images = basis[:, : 2 * block], images[:, : 2 * block]
        near = np.flatnonzero(far[:block])
        theta, fixed = values[near], np.hstack([locked, basis[:, : min(block, basis.shape[1])]])

        def corrected(t: np.ndarray) -> np.ndarray:
            t = t - fixed @ (fixed.T @ t)
            t = product(t) - t * theta
            return t - fixed @ (fixed.T @ t)

        start = -residual[:, near]
        start -= fixed @ (fixed.T @ start)
        new = minres(corrected, start, STEPS)
    else:
        raise ArithmeticError(f"no {count} eigenpairs in {ROUNDS} rounds")
    small = locked.T @ product(locked)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = locked @ turn[:, ::-1]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0)[0]
    return values[::-1], vectors * np.where(largest < 0, -1.0, 1.0)


def _orthonormal_add(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Both side by side, each new column freed from those before it."""
    for column in more.T:
        for _ in range(2):
            column = column - basis @ (basis.T @ column)
        basis = np.column_stack([basis, column / np.linalg.norm(column)])
    return basis


# --- the fit list and products over it


class Fit:
    """The distinct vectors with their count and sums."""

    def __init__(self, vectors: DataFrame, width: int, n: int, sums: list[int]):
        self.vectors, self.width, self.n, self.sums = vectors, width, n, sums

    def centred(self, column: pa.Array) -> np.ndarray:
        """n * x - S of an Arrow column of vectors, as whole numbers."""
        return _centred(column, self.width, self.n, self.sums)

    def summed(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of `part` over all blocks of centred rows, in one pass."""
        width, n, sums = self.width, self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += part(_centred(batch.column(0), width, n, sums).astype(np.float64) / n)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for value in batch.column(0):
                    total += np.frombuffer(value.as_buffer(), np.float64).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        partial = self.vectors.select("x").mapInArrow(run, "total binary")
        if self.tasks > FEW:
            partial = partial.repartition(math.isqrt(self.tasks)).mapInArrow(add, "total binary")
        rows = partial.toArrow().column("total").to_pylist()
        return np.sum([np.frombuffer(row, np.float64).reshape(shape) for row in rows], axis=0) if rows else np.zeros(shape)

    @property
    def tasks(self) -> int:
        if not hasattr(self, "_tasks"):
            self._tasks = self.vectors.rdd.getNumPartitions()
        return self._tasks

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        return self.summed(lambda x: x.T @ (x @ block), block.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda x: (x * x).sum(axis=0)[None], (1, self.width)).sum() / self.n)

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """The covariance of the rows' projections, from the projections themselves."""

        def part(x: np.ndarray) -> np.ndarray:
            y = x @ projection
            return y.T @ y

        return self.summed(part, (projection.shape[1],) * 2) / self.n


def _centred(column: pa.Array, width: int, n: int, sums: list[int]) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    bound = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums), 0)
    if bound < LARGEST // 2:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exact; None beyond 64 bits."""
    if centred.dtype != object:
        rough = (centred.astype(np.float64) ** 2).sum(axis=1)
        if rough.max(initial=0.0) < LARGEST:
            return (centred * centred).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in centred]
    return [value if value < 1 << 63 else None for value in exact]


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that take part, all of one width, stored; and the width."""
    c = F.col(column).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.filter(F.col(column).isNotNull() & fine)
    bounded = lambda v: F.least(F.greatest(F.floor(v * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)) + SHIFT
    rows = stored(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, bounded).alias("x")), "vectors")
    least, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != width:
        rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    return rows, width or 0


def fit_list(rows: DataFrame, width: int) -> Fit:
    """Each distinct vector once, with exact sums."""
    distinct = stored(rows.select("x").distinct(), "fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = [0] * width, 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            small = int(np.abs(x).max(initial=0)) * len(x) < LARGEST
            totals = [a + int(b) for a, b in zip(totals, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
            n += batch.num_rows
        # the place after the last dimension holds the count
        values = pa.array([decimal.Decimal(v) for v in [*totals, n]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), values], names=["place", "value"])

    found = distinct.mapInArrow(run, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    by_place = {row["place"]: int(row["value"]) for row in found}
    return Fit(distinct, width, by_place.get(width, 0), [by_place.get(i, 0) for i in range(width)])


def whitened(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row per vector and component: its whitened coordinate, with figures of the fit."""
    rows, width = whole_numbers(vectors, column)
    spark = vectors.sparkSession
    if not width:
        return spark.createDataFrame([], SCHEMA)
    fit = fit_list(rows, width)
    trace = fit.trace()
    if trace <= 0:
        return spark.createDataFrame([], SCHEMA)
    values, axes = leading_pairs(fit.product, width, components)
    real = values > 64 * width * np.finfo(float).eps * values[0]
    values, axes = values[real], axes[:, real]
    scaled = axes / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(scaled) - np.eye(len(values))).max())
    n, sums, explained = fit.n, fit.sums, values / trace
    count = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(batch.column(1), width, n, sums)
            coordinates = (centred.astype(np.float64) / n) @ scaled
            repeat = np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(repeat)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(repeat), n)),
                    pa.array(_deviations(centred), pa.int64()).take(pa.array(repeat)),
                    pa.array(coordinates.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                    pa.array(np.full(len(repeat), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
