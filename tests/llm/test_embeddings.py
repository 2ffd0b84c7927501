"""Embedding near duplicates against all pairs, and vectors that link with nothing."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, class string, n string, table string"


def _clusters(seed, sizes, dimension=48, noise=0.12):
    draw = np.random.default_rng(seed)
    vectors = []
    for size in sizes:
        centre = draw.standard_normal(dimension)
        centre /= np.linalg.norm(centre)
        vectors += [centre + noise / math.sqrt(dimension) * draw.standard_normal(dimension) * 2 for _ in range(size)]
    return [[float(np.float32(x)) for x in v] for v in vectors]


def _by_force(rows, threshold=embeddings.THRESHOLD):
    """Links by double-precision cosine, by place in `rows`."""
    links = defaultdict(set)
    for i, (_, a, label_a) in enumerate(rows):
        for j, (_, b, label_b) in enumerate(rows[:i]):
            if label_a is None or label_a != label_b or not _usable(a) or not _usable(b) or len(a) != len(b):
                continue
            if np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def _usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _expected(rows):
    links = _by_force(rows)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, waiting = {i}, [i]
        while waiting:
            new = links[waiting.pop()] - seen
            seen |= new
            waiting += new
        component = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec_id, len(links[i]), component, vec_id == component))
    return out


def _found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return [tuple(r) for r in embeddings.near_duplicates(frame).collect()]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 16)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    """A large bucket is also cut into blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    vectors = _clusters(seed, [60, 1, 5, 2, 2, 1, 1, 9, 1, 3] + [1] * 40)
    rows = [(i * 3, v, i % 2) for i, v in enumerate(vectors)]
    expected, found = _expected(rows), _found(spark, rows)
    assert sum(r[1] for r in expected) > 500
    assert _sorted(found) == _sorted(expected)


def test_odd_vectors(spark):
    a, b = _clusters(3, [2], 8)
    rows = [
        (1, a, 0), (2, a, 0), (2, a, 0), (3, b, 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [], 0), (8, [0.0] * 8, 0),
        (9, [None, *a[1:]], 0), (10, [math.nan, *a[1:]], 0), (11, [math.inf, *a[1:]], 0), (12, [x * 3 for x in a], 0),
        (13, a[:4], 0), (14, [-x for x in a], 0), (None, a, 0), (None, None, None), (0, [1.0], 5), (20, [2.0], 5), (21, [-2.0], 5),
    ]
    assert _sorted(_found(spark, rows)) == _sorted(
        (i, n, c, i == c) for i, n, c, _ in _expected(rows)
    )


def test_doubles(spark):
    """Numbers beyond the range of floats, and a pair that only doubles tell from one at the threshold."""
    one = [1.0, 0.0]
    just, below = ([math.cos(a), math.sin(a)] for a in (math.acos(0.93) - 1e-9, math.acos(0.93) + 1e-9))
    rows = [(1, [1e39, 1e39], 0), (2, [1e300, 1.01e300], 0), (3, [1e-300, 1e-300], 0), (4, [1e300, -1e300], 0), (5, one, 1), (6, just, 1),
            (7, one, 2), (8, below, 2), (9, [5e-324, 0.0], 3), (10, [2.0, 0.0], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (1, 9), 10: (1, 9)}


def test_an_empty_table(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_more_vectors_get_longer_keys_and_the_same_expected_recall():
    for vectors in (10, 10_000, 10**9):
        bits, tables = embeddings.table_sizes(vectors)
        meet = (1 - math.acos(embeddings.THRESHOLD) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= embeddings.RECALL
        assert vectors / 2**bits <= 1 / 8 or bits == 8


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.83, 0.99])
@pytest.mark.parametrize("vectors", [7500, 1_000_000])
def test_recall_does_not_fall_with_a_common_mean(mean, vectors):
    """Pairs at the threshold meet in some table, however large the mean that all vectors share."""
    draw = np.random.default_rng(4)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def some(count):
        own = unit(draw.standard_normal((count, 64)))
        return unit(mean * unit(np.ones((1, 64))) + math.sqrt(1 - mean**2) * own)

    rotations = embeddings.learn(some(4000), vectors)
    one, towards = some(1500), draw.standard_normal((1500, 64))
    towards = unit(towards - (towards * one).sum(axis=1, keepdims=True) * one)
    other = embeddings.THRESHOLD * one + math.sqrt(1 - embeddings.THRESHOLD**2) * towards
    assert (rotations.keys(one) == rotations.keys(other)).any(axis=1).mean() >= 0.985
    bits, tables = embeddings.table_sizes(vectors)
    assert rotations.tables <= 2 * tables
    if not mean:  # little is added where nothing is missing
        assert rotations.key_bits == bits and rotations.tables <= 1.3 * tables
