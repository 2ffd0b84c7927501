"""Centroid clustering against plain loops over whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from ledgerlens.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, distance string, n string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def _brute(rows, clusters, rounds, dimensions):
    kept = [
        (i, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)
    ]
    draw = sorted(kept, key=lambda row: (hashlib.sha256(f"2:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]))
    centroids = [x for _, x in draw[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), cluster in zip(kept, at, strict=True) if cluster == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    of_cluster = {k: sum(d for _, c, d in found if c == k) for k in range(len(centroids))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, of_cluster[k], sum(of_cluster.values()), digests[k]) for i, k, d in found), key=str)


def _found(frame, *args):
    return sorted(map(tuple, clustering.cluster(frame, *args).collect()), key=str)


def _vectors(seed, count, dimensions, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((7, dimensions))
    return [(int(i), (centres[draw.integers(7)] + spread * draw.standard_normal(dimensions)).astype(np.float32).tolist()) for i in range(count)]


@pytest.mark.parametrize(("seed", "clusters", "dimensions", "spread"), [(1, 12, 64, 0.3), (2, 40, 3, 1.0), (3, 5, 2, 0.01), (4, 1, 4, 1.0)])
def test_clusters_are_those_of_plain_loops(spark, seed, clusters, dimensions, spread):
    rows = _vectors(seed, 300, dimensions, spread)
    assert _found(_frame(spark, rows), clusters, 5, dimensions) == _brute(rows, clusters, 5, dimensions)


def test_ties_repeated_rows_and_empty_clusters(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0]) for i in range(60)]
    rows = grid + grid[:7] + [(None, [9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5])]
    # Equal vectors are drawn as several centroids: all but the first of these stay empty.
    assert _found(_frame(spark, rows), 20, 5, 3) == _brute(rows, 20, 5, 3)


def test_rows_that_are_left_out_and_few_rows(spark):
    good = [0.25, -0.001, 3.0]
    rows = [(1, good), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [float("inf"), 0.0, 0.0]),
            (6, [1.0, 2.0]), (7, []), (8, [-0.5, 0.5, 1e-9])]
    found = _found(_frame(spark, rows), 40, 5, 3)
    assert found == _brute(rows, 40, 5, 3) and [row[0] for row in found] == [1, 8]
    assert _found(_frame(spark, rows[1:7]), 40, 5, 3) == []
    assert _found(_frame(spark, rows).limit(0), 40, 5, 3) == []


def test_doubles_and_numbers_too_large(spark):
    frame = spark.createDataFrame([(1, [0.1, 1000.0]), (2, [0.3, -1000.0])], "vec_id long, embedding array<double>")
    assert [row["distance"] for row in clustering.cluster(frame, 2, 1, 2).collect()] == [0, 0]
    with pytest.raises(Exception, match="would not fit a long"):
        clustering.cluster(spark.createDataFrame([(1, [1e30, 0.0])], frame.schema), 2, 1, 2).collect()


def test_orchard_compares_less_than_all_and_finds_the_same():
    draw = np.random.default_rng(5)
    centroids = draw.integers(-5000, 5000, (200, 8))
    vectors = centroids[draw.integers(200, size=3000)] + draw.integers(-200, 200, (3000, 8))
    orchard = clustering.Orchard(centroids)
    at, near = orchard.search(vectors)
    distances = ((vectors[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (at == distances.argmin(axis=1)).all() and (near == distances.min(axis=1)).all()
    assert orchard.compared < 0.35 * distances.size


def test_a_centroid_at_exactly_twice_the_distance_is_compared():
    # The vector is in the middle: both centroids are as near, and the second lies at twice the distance of the first.
    at, near = clustering.Orchard(np.array([[4, 0], [0, 0]])).search(np.array([[2, 0]]))
    assert (at.tolist(), near.tolist()) == ([0], [4])
    orchard = clustering.Orchard(np.array([[100, 0], [4, 0], [0, 0], [4, 0]]))
    orchard.pivots = np.array([2])
    assert orchard.search(np.array([[2, 0]]))[0].tolist() == [1]
