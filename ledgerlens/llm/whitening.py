"""Embedding whitening: the leading principal components by Jacobi-Davidson, from products over all vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import write_table

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
LARGEST = 1 << 40  # of a component's number before the shift
INNER = 4  # MINRES steps for a correction
ROUNDING = 2.0**-46  # a residual of this share of the largest eigenvalue is double precision
NO_VARIANCE = 2.0**-40  # components with a smaller share of the largest eigenvalue are none
ROWS = 256  # vectors in one partial product
BITS = 118  # sums of parts are whole numbers of at most so many bits, which decimals hold

Product = Callable[[np.ndarray], np.ndarray]


def _minres(product: Product, shifts: np.ndarray, off: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - off off')(V - shift)(I - off off') t = right, a column for each shift, in step.

    Each step is one product for all columns. `right` is orthogonal to `off`.
    """

    def project(block: np.ndarray) -> np.ndarray:
        return block - off @ (off.T @ block)

    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    rest = beta.copy()
    before, now = np.zeros_like(right), np.divide(right, beta, out=np.zeros_like(right), where=live)
    beta = np.zeros_like(beta)
    cosine, sine = (np.ones_like(beta), np.ones_like(beta)), (np.zeros_like(beta), np.zeros_like(beta))
    directions = np.zeros_like(right), np.zeros_like(right)
    found = np.zeros_like(right)
    for _ in range(steps):
        after = project(product(now) - now * shifts)
        alpha = (now * after).sum(axis=0)
        after = after - now * alpha - before * beta
        length = np.linalg.norm(after, axis=0)
        delta = cosine[1] * alpha - cosine[0] * sine[1] * beta
        rho = np.hypot(delta, length)
        live = live & (rho > 0)
        scale = np.divide(1.0, rho, out=np.zeros_like(rho), where=live)
        direction = (now - directions[0] * (sine[0] * beta) - directions[1] * (sine[1] * alpha + cosine[0] * cosine[1] * beta)) * scale
        turn = delta * scale, length * scale
        found += direction * (turn[0] * rest)
        rest = -turn[1] * rest
        cosine, sine = (cosine[1], turn[0]), (sine[1], turn[1])
        directions = directions[1], direction
        live = live & (length > 0)
        before, now, beta = now, np.divide(after, length, out=np.zeros_like(after), where=live), length
        if not live.any():
            break
    return found


def _orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block adds to others; columns that add nothing but rounding are left out."""
    kept: list[np.ndarray] = []
    for column in block.T:
        for _ in range(3):  # what cancels leaves rounding, which is taken away again
            length = np.linalg.norm(column)
            if length == 0:
                break
            column = column / length
            for other in (*others, *([np.column_stack(kept)] if kept else [])):
                column = column - other @ (other.T @ column)
            if np.linalg.norm(column) < 1e-10:
                column = np.zeros_like(column)
        if length := np.linalg.norm(column):
            kept.append(column / length)
    return np.column_stack(kept) if kept else np.empty((len(block), 0))


def leading(
    product: Product, dimensions: int, wanted: int, inner: int = INNER, most: int | None = None, rounds: int = 200
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric operator without negative ones, and unit eigenvectors, by block Jacobi-Davidson.

    `product` gives the operator times the columns of a block; nothing else
    of it is seen. Each round takes the Ritz pairs of the subspace, locks
    those whose residual is down to rounding, from the largest on, and
    widens the subspace by approximate solutions of their projected correction
    equations for all others. A subspace of more than `most` columns starts anew from its best Ritz vectors.
    """
    most = most or min(dimensions, max(4 * wanted, 64))
    start = np.random.default_rng(13).standard_normal((dimensions, min(wanted + 2, dimensions)))
    locked, values = np.empty((dimensions, 0)), []
    basis = _orthonormal(start)
    image = product(basis)
    largest = 0.0
    for _ in range(rounds):
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        largest = max(largest, ritz[0] if len(ritz) else 0.0)
        left = min(wanted - len(values), len(ritz))
        residual = image[:, :left] - basis[:, :left] * ritz[:left]
        residual -= locked @ (locked.T @ residual)
        good = np.linalg.norm(residual, axis=0) <= ROUNDING * largest
        done = left if good.all() else int(np.argmin(good))
        values += ritz[:done].tolist()
        locked = np.column_stack((locked, _orthonormal(basis[:, :done], locked)))
        if len(values) == wanted or locked.shape[1] == dimensions:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        basis, image, ritz, residual = basis[:, done:], image[:, done:], ritz[done:], residual[:, done:]
        near = basis[:, : residual.shape[1]]
        if basis.shape[1] + near.shape[1] > most:
            keep = max(most // 2, near.shape[1])
            basis, image = basis[:, :keep], image[:, :keep]
        correction = _minres(product, ritz[: near.shape[1]], np.column_stack((locked, near)), -residual, inner)
        added = _orthonormal(correction, locked, basis)
        if not added.shape[1] and basis.shape[1] + locked.shape[1] < dimensions:  # corrections are spent: look elsewhere
            added = _orthonormal(np.random.default_rng(len(values)).standard_normal((dimensions, wanted)), locked, basis)
        # Columns that gained rounding since are made orthogonal again, and so have their product taken anew.
        fresh = _orthonormal(np.column_stack((basis, added)), locked)
        if fresh.shape[1] == basis.shape[1] + added.shape[1] and added.shape[1]:
            basis, image = np.column_stack((basis, added)), np.column_stack((image, product(added)))
        else:
            basis = fresh
            image = product(basis)
    raise RuntimeError(f"{wanted - len(values)} of {wanted} components have not converged in {rounds} rounds")


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose embedding has components, all of them finite: x is floor(64 * component).

    The shift that the numbers get elsewhere takes nothing away from differences, and is left out here.
    A component beyond LARGEST / 64 fails the job, as its number would not be exact.
    """
    value = F.col("embedding").cast("array<double>")
    usable = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(value, lambda c: F.floor(c * F.lit(float(SCALE))))
    fits = F.when(
        F.exists(value, lambda c: F.abs(c) * F.lit(float(SCALE)) > F.lit(float(LARGEST))),
        F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}: its number would not be exact")),
    )
    return vectors.filter((F.size("embedding") > 0) & usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(fits.cast("array<bigint>"), scaled).alias("x")
    )


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[np.ndarray]:
    for batch in batches:
        for some in range(0, batch.num_rows, rows):
            column = batch.column("x").slice(some, rows)
            yield column.flatten().to_numpy().reshape(len(column), -1)


def _totals(fit: DataFrame, part: Callable[[Iterator[np.ndarray]], list[int]]) -> list[int]:
    """Sums over all tasks of the whole numbers that `part` makes of a task's vectors.

    Whole numbers add up to the same total in any order, so a task that runs
    again changes nothing. One row per number and task is shuffled, one per number reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = part(_blocks(batches))
        columns = [pa.array(range(len(numbers)), pa.int32()), pa.array(list(map(Decimal, numbers)), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "number"])

    added = fit.select("x").mapInArrow(add, "place int, number decimal(38,0)").groupBy("place").agg(F.sum("number").alias("sum"))
    return [int(row["sum"]) for row in sorted(added.collect())]


@dataclass
class Centre:
    """How many distinct vectors there are, and the sums of their numbers by dimension."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: whole numbers, exact, whatever their size."""
        largest = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.sums))
        kind = np.int64 if largest < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; each rounded once, also where both are far larger than their difference."""
        return (self.deviations(x) / self.n).astype(np.float64)


def _whole(block: np.ndarray, unit: int) -> list[int]:
    """Numbers of extended precision as whole multiples of 2^unit."""
    high = block.astype(np.float64)
    low = (block - high).astype(np.float64)
    return [
        int(math.ldexp(h, -unit)) + int(math.ldexp(l, -unit)) for h, l in zip(high.ravel().tolist(), low.ravel().tolist(), strict=True)
    ]


def _summed(fit: DataFrame, bound: float, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of vectors of matrices, whose numbers add up to `bound` at most."""
    unit = math.frexp(bound)[1] - BITS

    def part(blocks: Iterator[np.ndarray]) -> list[int]:
        total = np.zeros(shape, np.longdouble)
        for block in blocks:
            total += of(block)
        return _whole(total, unit)

    return np.array([math.ldexp(number, unit) for number in _totals(fit, part) or [0] * math.prod(shape)]).reshape(shape)


@dataclass
class Whitener:
    """A centre, and the largest eigenvalues of the covariance around it with unit eigenvectors as columns."""

    centre: Centre
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def learn(fit: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitener | None:
    """Principal components of the vectors `x` of `fit`, each row of which counts once; None if nothing varies.

    The covariance is never formed: a product with it is one pass over the
    vectors, which centres each before it is multiplied. The directions of
    components are free; here the largest entry is positive.
    """

    def moments(blocks: Iterator[np.ndarray]) -> list[int]:
        rows, sums, squares = 0, [0] * dimensions, [0] * dimensions
        for block in blocks:
            rows += len(block)
            exact = block if int(np.abs(block).max(initial=0)) < 1 << 26 else block.astype(object)
            sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0).tolist(), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (exact * exact).sum(axis=0).tolist(), strict=True)]
        return [rows, *sums, *squares]

    n, *rest = _totals(fit, moments)
    if n < 2:
        return None
    sums, squares = rest[:dimensions], rest[dimensions:]
    spread = sum(n * square - total * total for total, square in zip(sums, squares, strict=True))  # n^2 times the trace
    if not spread:
        return None
    centre, trace = Centre(n, sums), spread / (n * n)

    def product(block: np.ndarray) -> np.ndarray:
        def times(x: np.ndarray) -> np.ndarray:
            centred = centre.centred(x)
            return centred.T @ (centred @ block)

        # Columns are of length one, so no sum of products exceeds that of all squares.
        return _summed(fit, 4 * trace * n, block.shape, times) / n

    values, vectors = leading(product, dimensions, min(components, dimensions, n - 1))
    some = values > NO_VARIANCE * values[0]
    values, vectors = values[some], vectors[:, some]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Whitener(centre, trace, values, vectors * sign)


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, from one more pass over the vectors."""
    count, n = len(whitener.values), whitener.centre.n

    def products(x: np.ndarray) -> np.ndarray:
        z = whitener.whitened(x)
        return np.column_stack((z, np.ones(len(z)))).T @ z

    sums = _summed(fit, 16.0 * n, (count + 1, count), products) / n
    return float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(count)).max())


COLUMNS = "vec_id long, component int, deviation decimal(38,0), whitened double"


def apply(kept: DataFrame, whitener: Whitener) -> DataFrame:
    """(vec_id, component, deviation, whitened) of each row of (vec_id, x) and each component, numbered from 1."""
    count = len(whitener.values)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, ROWS):
                part = batch.slice(some, ROWS)
                x = next(_blocks(iter([part])))
                apart = whitener.centre.deviations(x)
                if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
                    apart = apart.astype(object)
                squares = pa.array([int(square) for square in (apart * apart).sum(axis=1).tolist()])
                rows = np.repeat(np.arange(len(x)), count)
                columns = [
                    part.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    squares.cast(pa.decimal128(38, 0)).take(pa.array(rows)),
                    pa.array(whitener.whitened(x).ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened"])

    return kept.mapInArrow(whiten, COLUMNS)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates: vec_id, component, n, deviation, whitened, explained, identity_error; a row per vector and component.

    `vectors` has vec_id and embedding; other columns are not looked at. Rows
    whose embedding is null, empty, or holds a null or a non-finite number are left
    out; so are rows whose number of components is not the most frequent one (of
    equally frequent ones the smallest). Repeated rows have their rows each, but
    each distinct vector of numbers floor(64 * component) + 1000000 counts once
    in the mean, the covariance and `n`. A missing vec_id stays missing.
    deviation is the exact sum of (n * x - sum of x)^2 over the dimensions. There are as
    many components as asked for, or as have variance; where nothing
    varies, as with a single vector, or without vectors, there are no rows.
    """
    spark = vectors.sparkSession
    kept = write_table(whole_vectors(vectors).withColumn("size", F.size("x")), "whole-vectors")
    frequent = kept.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    whitener = None
    if frequent:
        kept = kept.filter(F.col("size") == frequent["size"])
        fit = write_table(kept.select("x").distinct(), "distinct-vectors")
        whitener = learn(fit, frequent["size"], components)
    if whitener is None:
        return spark.createDataFrame(
            [], COLUMNS.replace("component int,", "component int, n long,") + ", explained double, identity_error double"
        )
    explained = F.array(*(F.lit(float(value / whitener.trace)) for value in whitener.values))
    return apply(kept.select("vec_id", "x"), whitener).select(
        "vec_id",
        "component",
        F.lit(whitener.centre.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("component") - 1].alias("explained"),
        F.lit(identity_error(fit, whitener)).alias("identity_error"),
    )
