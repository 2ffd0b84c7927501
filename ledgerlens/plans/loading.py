"""Loading the fact table from CSV, with a report of what was accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.csv_load import load_csv_table


def load_fact(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Load the fact table and report rows and value, per load state and channel."""
    load = load_csv_table(spark, "fact_transactions", source, target)
    accepted = load.accepted.groupBy(F.lit("accepted").alias("load_state"), "channel").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount_usd").cast("double").alias("total_value_usd")
    )
    rejected = load.rejected.groupBy(F.lit("rejected").alias("load_state")).agg(F.count(F.lit(1)).alias("row_count"))
    nothing = rejected.withColumns(
        {"channel": F.lit(None).cast("string"), "total_value_usd": F.lit(None).cast("double")}
    )
    return accepted.unionByName(nothing)
