"""Rendezvous hashing: the law of keys, weights, and gapless slots."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm import sharding

EVEN = [1.0] * 8


def _placed(spark, weights, count=4000):
    return {
        row["id"]: row["shard"]
        for row in spark.range(count).select("id", sharding.rendezvous_shard(F.col("id"), weights).alias("shard")).collect()
    }


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = _placed(spark, EVEN), _placed(spark, [*EVEN, 1.0])
    moved = {i for i in before if before[i] != after[i]}
    assert all(after[i] == 8 for i in moved)
    assert 0.08 < len(moved) / len(before) < 0.14


def test_shares_follow_the_weights(spark):
    counts = Counter(_placed(spark, [1.0, 2.0, 0.0, 1.0]).values())
    assert counts[2] == 0
    assert abs(counts[1] / 4000 - 0.5) < 0.04 and abs(counts[0] / 4000 - 0.25) < 0.04


def test_a_heavier_shard_only_gains(spark):
    before, after = _placed(spark, [1.0, 1.0, 1.0]), _placed(spark, [1.0, 1.5, 1.0])
    assert {after[i] for i in before if before[i] != after[i]} == {1}


def test_rows_of_any_kind_get_a_slot(spark, documents):
    rows = [(1, "a", "en"), (1, "a", "en"), (None, None, None), (None, "", "en"), (2, "é\U0001f600" * 5000, None), (3, None, "de")]
    rows += [(7, "same", "en")] * 200
    found = sharding.shard_table(documents(rows, extra=True), "doc_id", EVEN, [*EVEN, 1.0]).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for row in found:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(numbers) == list(range(len(numbers))) for numbers in slots.values())
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    assert len({r["shard"] for r in found if r["doc_id"] is None}) == 1


def test_an_empty_table(documents):
    assert sharding.shard_table(documents([]), "doc_id", EVEN).collect() == []


def test_shards_are_written_whole(spark, documents, tmp_path):
    docs = documents([(i, f"text {i}", "en") for i in range(50)])
    sharding.write_shards(docs, "doc_id", EVEN, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, docs.collect()))
