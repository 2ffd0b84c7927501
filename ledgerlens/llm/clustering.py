"""Centroid clustering in whole numbers: every vector finds its nearest centroid by Orchard search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import write_table

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LARGEST = 1 << 27  # of a component's number, so that 64 squared differences add up in 64 bits
ROWS = 2048  # vectors that are searched for at once


class Orchard:
    """Nearest centroids by Orchard's search, for many vectors in step.

    Each centroid keeps the others sorted by their distance from it. A vector
    stands at a centroid and walks that one's list. A centroid that is closer
    (or as close, with a smaller number) is where it stands from then on, at
    the start of the list there; what it has met on its way is marked and not
    compared again. It stops at the first list member that is strictly
    farther from where it stands than twice its own distance: what follows
    is farther from the vector than that. All distances are squared and exact, so that
    the stop is at four times the squared distance, and ties are seen.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = ((centroids[:, None, :] - centroids) ** 2).sum(axis=2)
        self.neighbours = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.neighbours, axis=1)
        # Where to start does not change the result: at the best of a few centroids, spread over their numbers.
        some = max(math.isqrt(len(centroids)), 1)
        self.pivots = np.arange(some) * len(centroids) // some
        self.compared = 0

    def _distance(self, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.compared += len(at)
        apart = vectors - self.centroids[at]
        return np.einsum("ij,ij->i", apart, apart)

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, of equally near ones the first, and the squared distance."""
        rows, last = len(vectors), len(self.centroids)
        met = np.zeros((rows, last), bool)
        at, near = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max)
        for pivot in self.pivots:
            distance = self._distance(vectors, np.full(rows, pivot))
            met[:, pivot] = True
            closer = distance < near
            at, near = np.where(closer, pivot, at), np.where(closer, distance, near)
        place = np.zeros(rows, np.int64)
        walking = np.arange(rows)
        while len(walking):
            here, step = at[walking], place[walking]
            beyond = step >= last
            step = np.minimum(step, last - 1)
            # 4 * near may not fit in 64 bits, near itself does.
            beyond |= self.apart[here, step] > 4 * np.minimum(near[walking], np.iinfo(np.int64).max // 4)
            walking, here, step = walking[~beyond], here[~beyond], step[~beyond]
            other = self.neighbours[here, step]
            place[walking] += 1
            fresh = ~met[walking, other]
            new, other = walking[fresh], other[fresh]
            met[new, other] = True
            distance = self._distance(vectors[new], other)
            better = (distance < near[new]) | ((distance == near[new]) & (other < at[new]))
            moved = new[better]
            at[moved], near[moved], place[moved] = other[better], distance[better], 0
        return at, near


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, x) of the rows whose embedding has so many components, all of them finite: x is floor(256 * component).

    A component beyond LARGEST / 256 fails the job, as its distances would not fit a long.
    """
    value = F.col("embedding").cast("array<double>")
    usable = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(value, lambda c: F.floor(c * F.lit(float(SCALE))))
    fits = F.when(
        F.exists(value, lambda c: F.abs(c) * F.lit(float(SCALE)) > F.lit(float(LARGEST))),
        F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}: squared distances would not fit a long")),
    )
    return (
        vectors.filter((F.size("embedding") == dimensions) & usable)
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(fits.cast("array<bigint>"), scaled).alias("x"))
    )


def _draw(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("2:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each row of (vec_id, x); the centroids go along with the function."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        for batch in batches:
            for some in range(0, batch.num_rows, ROWS):
                part = batch.slice(some, ROWS)
                cluster, distance = orchard.search(_matrix(part.column("x")))
                columns = [part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(search, "vec_id long, cluster int, distance long")


def _sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors: how many, and their sum.

    A task adds its own vectors up first, so at most one row per cluster and task is shuffled.
    """
    count, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        sizes, sums = np.zeros(count, np.int64), np.zeros((count, width), np.int64)

        def rows() -> pa.RecordBatch:
            full = np.flatnonzero(sizes)
            columns = [pa.array(full, pa.int32()), pa.array(sizes[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

        for batch in batches:
            for some in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("x").slice(some, ROWS))
                cluster, _ = orchard.search(x)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
                sizes[found] += np.diff(np.append(first, len(order)))
            if sizes.sum() > 1 << 32:  # sums of numbers up to 2^27 still fit
                yield rows()
                sizes[:], sums[:] = 0, 0
        yield rows()

    # Sums of all tasks may exceed a long: decimals hold them whole.
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    added = kept.mapInArrow(add, "cluster int, n long, sums array<long>")
    found = added.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()  # a row per centroid at most
    return {row["cluster"]: (row["n"], [int(row[f"s{i}"]) for i in range(width)]) for row in found}


def learn(kept: DataFrame, clusters: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many rounds, from the vectors with the smallest hashes of their ids on.

    Vectors whose ids are equal (or missing) go by their components. Fewer
    vectors than `clusters` give as many centroids. A centroid that no vector
    is nearest to stays where it is.
    """
    first = kept.orderBy(_draw(F.col("vec_id")), "x").limit(clusters).select("x").collect()
    centroids = np.array([row["x"] for row in first], np.int64)
    for _ in range(rounds if len(first) else 0):
        for cluster, (n, sums) in _sums(kept, centroids).items():
            centroids[cluster] = [total // n for total in sums]  # Python's // is the exact floor
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, clusters: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    `vectors` has vec_id and embedding; other columns are not looked at. Rows
    whose embedding is null, has another number of components, or holds a null or
    a non-finite one, are left out; repeated rows count each, also as first centroids. A missing
    vec_id is hashed as an empty text. Distances are squared, of whole numbers, and
    ties go to the smaller centroid number. Without vectors there are no rows.
    Inertias are the sums of distances over the cluster and over all vectors.
    """
    kept = write_table(whole_vectors(vectors, dimensions), "whole-vectors")
    centroids = learn(kept, clusters, rounds)
    spark = vectors.sparkSession
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {schema.partition(', ')[2]}")
    found = write_table(assign(kept, centroids), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()
    inertia = {row["cluster"]: int(row["sum"]) for row in sums}
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), digest(centroid)) for i, centroid in enumerate(centroids)]
    table = F.broadcast(spark.createDataFrame(rows, schema))  # a row per centroid
    return found.join(table, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
