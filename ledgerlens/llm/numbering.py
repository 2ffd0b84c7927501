"""Gapless numbers within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import write_table

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within a partition in its low 33 bits


def number_within(frame: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within each group, in the given order; rows that tie get any order.

    Rows are range-partitioned by group, order and a random value, so that
    neither a large group nor rows that are all equal meet in one task. The
    sorted rows are written out, because sampled range bounds change when
    they are computed anew. A row's number is its place in its partition's
    run of the group, plus the sizes of the group's runs in the partitions
    before; there are at most as many runs as partitions and groups together.

    `frame` is read twice and should be a stored table. Group columns hold no nulls.
    """
    keys = [*group, *order, "_spread"]
    ordered = write_table(
        frame.withColumn("_spread", F.rand(17))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_spread")
        .withColumn("_position", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_position", _ROW_BITS)),
        "numbered",
    )
    runs = ordered.groupBy(*group, "_part").agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *group, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        ordered.join(starts, [*group, "_part"])
        .withColumn(name, F.col("_position") + F.col("_shift"))
        .drop("_position", "_part", "_shift")
    )
