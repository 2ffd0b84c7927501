"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import write_table


def _stars(links: DataFrame, smaller_only: bool) -> DataFrame:
    """Join a node's neighbours to the smallest of them and itself.

    With `smaller_only`, the neighbours are the smaller ones, and the node
    itself joins too; otherwise only larger neighbours are joined.
    """
    both = links if smaller_only else links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    # Stored, so that the join starts from a shuffle of either side, which Spark can split at a node with many links.
    hubs = write_table(
        both.groupBy("high").agg(F.min("low").alias("least")).withColumn("hub", F.least("high", "least")), "hubs"
    )
    joined = both.join(hubs.select("high", "hub"), "high")
    if smaller_only:
        moved = joined.select("hub", F.col("low").alias("node")).union(hubs.select("hub", F.col("high").alias("node")))
    else:
        moved = joined.filter("low > high").select("hub", F.col("low").alias("node"))
    return moved.filter("node <> hub").select(F.col("node").alias("high"), F.col("hub").alias("low")).distinct()


def components(links: DataFrame, left: Column | str = "left", right: Column | str = "right") -> DataFrame:
    """For each node that has a link to another: node and component, the smallest node it can reach.

    Nodes are whole numbers; links have no direction and may repeat. Large-
    and small-star steps by turns bring every node next to its smallest one in
    a logarithmic number of rounds. A node's links are never gathered: steps
    are a minimum by node and a join that Spark can split. Each round's links are
    written to the shared folder; the driver sees only a checksum of them.
    """
    left, right = (F.col(side) if isinstance(side, str) else side for side in (left, right))
    current = write_table(
        links.filter(left != right)
        .select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        # Nodes can have any 64-bit number: only hashes are added up, as decimals.
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
        if state == before:
            return current.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
                current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        before = state
        current = write_table(_stars(_stars(current, False), True), "links")
