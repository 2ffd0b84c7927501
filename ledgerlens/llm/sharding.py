"""Shards by weighted rendezvous hashing of a stable record key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.numbering import number_within
from ledgerlens.session import write_table

_DIGITS = 13  # hex digits of the hash that make up a draw: 52 bits, exact in a double


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards, whose expected shares are as their weights.

    Every shard draws a uniform number u from the hash of key and shard, and
    the smallest -ln(u) / weight wins. The draws of the other shards do not
    change when one is added or removed or gets another weight, so keys move
    only to or from that shard. A shard of weight 0 gets no keys. A null key
    counts as an empty one.
    """
    if not any(weight > 0 for weight in weights) or any(weight < 0 for weight in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), text)), 1, _DIGITS)
            uniform = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**_DIGITS))
            draws.append(F.struct((-F.log(uniform) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def shard_table(
    frame: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, text: str = "text"
) -> DataFrame:
    """One narrow row per record: key, size, text_crc32, shard, slot and grown_shard.

    size is the UTF-8 length of the text plus 1, text_crc32 the unsigned CRC
    of its bytes (null text: none, 0). slot numbers a shard's records from 0
    by key, size and CRC; equal rows get numbers of their own. grown_shard is
    the shard under the weights `grown`, null without them. Records with one
    key, null included, share a shard. Only narrow rows are shuffled, and a
    shard is numbered by many tasks. An empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = frame.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        (rendezvous_shard(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_within(write_table(narrow, "shards"), ["shard"], [key, "size", "text_crc32"], "slot")


def write_shards(frame: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Write whole records as Parquet, one folder shard=N per shard, without a shuffle."""
    frame.withColumn("shard", rendezvous_shard(F.col(key), weights)).write.partitionBy("shard").parquet(path)
