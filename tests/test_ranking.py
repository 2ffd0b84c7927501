"""Quintiles and running shares against plain windows and Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import ranking
from ledgerlens.operators.ranking import quantile_cutoffs, running_total_by_value, with_quantiles
from ledgerlens.session import write_table


def ntile_by_hand(rows, buckets=5):
    """rows of (key, value); NULL first, ties by key."""
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0))
    small, larger = divmod(len(ordered), buckets)
    sizes = [small + (i < larger) for i in range(buckets)]
    places = [bucket for bucket, size in enumerate(sizes, 1) for _ in range(size)]
    return dict(zip([key for key, _ in ordered], places, strict=True))


@pytest.mark.parametrize("members", [1, 2, 3, 4, 5, 6, 7, 23, 1000])
@pytest.mark.parametrize("spread", [0, 2, 1000])
def test_quintiles_equal_ntile(spark, members, spread):
    rng = random.Random(members * 31 + spread)
    rows = []
    for key in range(members):
        value = rng.randint(0, spread) if rng.random() > 0.1 else None
        rows.append((key * 7 - 50, value, rng.randint(-3, 3)))
    frame = write_table(spark.createDataFrame(rows, "key long, a long, b long"), "test")
    got = {r["key"]: (r["qa"], r["qb"]) for r in with_quantiles(frame, {"a": "qa", "b": "qb"}, "key").collect()}
    by_a, by_b = ntile_by_hand([(k, a) for k, a, _ in rows]), ntile_by_hand([(k, b) for k, _, b in rows])
    assert got == {k: (by_a[k], by_b[k]) for k, _, _ in rows}


def test_all_tied_sizes(spark):
    frame = write_table(spark.createDataFrame([(k, 1) for k in range(7)], "key long, v long"), "test")
    scored = with_quantiles(frame, {"v": "q"}, "key").groupBy("q").count().orderBy("q").collect()
    assert [r["count"] for r in scored] == [2, 2, 1, 1, 1]


def test_missing_key_ranks_first_among_its_ties(spark):
    rows = [(None, 1), (3, 1), (5, 1), (1, 0), (2, None)]
    frame = write_table(spark.createDataFrame(rows, "key long, v long"), "test")
    got = {r["key"]: r["q"] for r in with_quantiles(frame, {"v": "q"}, "key").collect()}
    assert got == {2: 1, 1: 2, None: 3, 3: 4, 5: 5}


def test_far_apart_and_missing_numbers(spark):
    rng = random.Random(8)
    edges = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, None, 1 << 40, -(1 << 40)]
    rows = [(key, rng.choice([*edges, rng.randint(-(1 << 62), 1 << 62)])) for key in [*range(-60, 60), (1 << 62), -(1 << 62)]]
    frame = write_table(spark.createDataFrame(rows, "key long, v long"), "test")
    got = {r["key"]: r["q"] for r in with_quantiles(frame, {"v": "q"}, "key").collect()}
    assert got == ntile_by_hand(rows)


def test_keys_are_all_missing_or_one(spark):
    frame = write_table(spark.createDataFrame([(None, 3)], "key long, v long"), "test")
    assert quantile_cutoffs(frame, ["v"], "key", 2) == {"v": [(3, None)]}
    frame = write_table(spark.createDataFrame([(9, 3)], "key long, v long"), "test")
    assert quantile_cutoffs(frame, ["v"], "key", 2) == {"v": [(3, 9)]}


def test_cutoffs_are_found_by_counting(spark, monkeypatch):
    """Nothing is sorted or written, and a pass returns at most one count per cutoff and digit."""
    rng = random.Random(9)
    rows = [(k, rng.randint(0, 10_000), rng.choice([0, 0, 0, 7])) for k in range(5000)]
    frame = write_table(spark.createDataFrame(rows, "key long, a long, b long"), "test")
    passes = []
    counted = ranking._histograms

    def watched(frame, probes, key):
        found = counted(frame, probes, key)
        passes.append(max(map(len, found.values())))
        return found

    monkeypatch.setattr(ranking, "_histograms", watched)
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: pytest.fail("sorted"))
    monkeypatch.setattr(DataFrame, "orderBy", lambda *a: pytest.fail("sorted"))
    cutoffs = quantile_cutoffs(frame, ["a", "b"], "key", 5)
    for name, index in (("a", 1), ("b", 2)):
        ordered = sorted((row[index], row[0]) for row in rows)
        assert cutoffs[name] == [ordered[i * 1000 - 1] for i in range(1, 5)]
    assert len(passes) <= 4 and max(passes) <= 4096


def test_no_members(spark):
    frame = write_table(spark.createDataFrame([], "key long, v long"), "test")
    assert with_quantiles(frame, {"v": "q"}, "key").count() == 0


def test_partition_count_does_not_matter(spark):
    rng = random.Random(3)
    frame = write_table(
        spark.createDataFrame([(k, rng.choice([0, 0, 0, 1, 9])) for k in range(500)], "key long, v long"), "test"
    )
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append(sorted(map(tuple, with_quantiles(frame, {"v": "q"}, "key").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_running_total_shares_ties(spark):
    frame = spark.createDataFrame([(5,), (3,), (3,), (1,)], "v long")
    got = {r["v"]: r["total"] for r in running_total_by_value(frame, "v", 20, "total").collect()}
    assert got == {5: 5, 3: 11, 1: 12}


def test_running_total_equals_range_window(spark):
    rng = random.Random(5)
    frame = spark.createDataFrame([(i, rng.randint(0, 30)) for i in range(300)], "i int, v long")
    wanted = frame.select("v", F.sum("v").over(Window.orderBy(F.desc("v"))).alias("t")).distinct()
    wanted = sorted(map(tuple, wanted.collect()), reverse=True)[:12]
    got = sorted(map(tuple, running_total_by_value(frame, "v", 12, "t").collect()), reverse=True)
    assert got == wanted


def test_a_pass_for_many_cutoffs_is_compiled(spark, monkeypatch, capsys):
    """Functions on array elements are interpreted for each row, and so are methods beyond 8000 bytes."""
    signals = [f"s{i}" for i in range(7)]
    frame = write_table(spark.range(500).select("id", *[(F.col("id") * (i + 3) % 11).alias(s) for i, s in enumerate(signals)]), "test")
    probes = [ranking._Probe(s, at, prefix, 4) for s in signals for at, prefix in ((None, 1 << 59), ((2,), 1 << 59), ((3,), 1 << 59), ((None,), 0))]
    collect = type(frame).collect

    def watched(self):
        rows = collect(self)
        self.explain("codegen")
        return rows

    monkeypatch.setattr(type(frame), "collect", watched)
    found = ranking._histograms(frame, probes, "id")
    monkeypatch.undo()
    plan = capsys.readouterr().out
    sizes = list(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan)))
    for i, s in enumerate(signals):
        values = [n * (i + 3) % 11 for n in range(500)]
        assert found[probes[4 * i]] == [(v, values.count(v)) for v in range(11) if v in values]
        assert found[probes[4 * i + 1]] == [(n, 1) for n in range(16) if values[n] == 2]
    assert sizes and max(sizes) < 8000 and "lambda" not in plan
