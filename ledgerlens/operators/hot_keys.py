"""Joining rows to a per-key table that may be too large to broadcast, or of which one key may hold a large part of the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key with more than one in this many rows is split
HELD_BYTES = 32 << 20  # of a table's rows, that any driver can hold
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's limit for broadcast tables; -1 where broadcasts are off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").lower()
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", text).groups()
    return int(number) * _UNITS[unit or "b"]


def _bytes_of(table: DataFrame, members: int) -> int:
    return members * 16 * len(table.columns)


def broadcast_by_rows(table: DataFrame) -> DataFrame:
    """A stored table whose joins shuffle once its rows, which are counted, take more than the session's limit and HELD_BYTES.

    Left to itself Spark goes by the size of the files, which after encoding and compression can be a hundredth of
    what the driver has to hold of the rows: 5.4 million customers with their country pass for 4.7 MB, while a
    sixth of them takes 74 MB.
    """
    held = max(HELD_BYTES, broadcast_bytes(table.sparkSession))
    return table if _bytes_of(table, table.count()) <= held else table.hint("merge")


def join_per_key(rows: DataFrame, table: DataFrame, key: str, weight: str, spread_by: list[str]) -> DataFrame:
    """Inner join of `rows` to a stored table of numbers with one row per key and the key's row count in `weight`.

    A table whose rows fit the session's limit for broadcasts is joined as it is. Otherwise both
    sides are shuffled, whatever the size of the table's files, and a hot key is divided into as many parts as it holds
    thousandths of the rows: each of its rows goes to a part by a hash of
    `spread_by`, and its table row to all of them. Fewer than HOT_SHARE keys
    can be hot, so the list of them is always small enough to broadcast.
    """
    members, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if _bytes_of(table, members) <= broadcast_bytes(rows.sparkSession):
        return rows.join(table, key)
    parts = F.ceil(F.col(weight) * HOT_SHARE / total).cast("int")
    hot = F.broadcast(table.filter(F.col(weight) * HOT_SHARE > total).select(key, parts.alias("parts")))
    part_of_row = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("parts")), F.lit(0)).cast("int")
    all_parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    divided_rows = rows.join(hot, key, "left").withColumn("part", part_of_row).drop("parts")
    divided_table = table.join(hot, key, "left").withColumn("part", all_parts).drop("parts")
    return divided_rows.join(divided_table.hint("merge"), [key, "part"]).drop("part")
