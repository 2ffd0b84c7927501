"""Integrity audits: foreign keys that match nothing, and figures that should agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans import scoring
from ledgerlens.sources.schema import FACT_KEYS
from ledgerlens.sources.star import Star


def orphan_audit(star: Star) -> DataFrame:
    """Fact rows an inner join would lose, per dimension: key missing, or key unknown.

    One pass over the fact counts rows by key for all dimensions at once,
    so that each task hands on a key once; the keys then meet those of all
    dimensions in one join.
    """
    dimensions = list(FACT_KEYS.items())

    def numbered(place: int, key: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), key.cast("bigint").alias("key"))

    keys = F.array(*(numbered(place, F.col(key)) for place, (_, key) in enumerate(dimensions)))
    per_key = star.fact.select(F.inline(keys)).groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(
        DataFrame.unionByName,
        [star.table(name).select(F.inline(F.array(numbered(place, F.col(key))))) for place, (name, key) in enumerate(dimensions)],
    )
    missing = F.col("key").isNull()
    lost = (
        per_key.join(known, ["place", "key"], "left_anti")
        .groupBy("place")
        .agg(F.sum(F.when(missing, F.col("n"))).alias("missing"), F.sum(F.when(~missing, F.col("n"))).alias("unknown"))
    )
    names = star.spark.createDataFrame(list(enumerate(FACT_KEYS)), "place int, dimension string")  # a row per dimension
    return names.join(lost, "place", "left").select(
        "dimension",
        F.coalesce("missing", F.lit(0)).alias("missing_key_rows"),
        F.coalesce("unknown", F.lit(0)).alias("unknown_key_rows"),
    )


def reference_number_check(star: Star, expected: dict[str, int] | None = None) -> DataFrame:
    """Figures that should agree: the parts of the fact against its total, and any expected totals.

    `expected` may name transactions, flagged_transactions or customers, as
    published elsewhere.
    """
    # Small groups first, so that the date join and the sums see few rows.
    counts = star.fact.groupBy("channel", "transaction_type", "transaction_hour", "date_key", "is_flagged").agg(
        F.count(F.lit(1)).alias("n")
    )
    dated = counts.join(star.date.select("date_key", F.lit(1).alias("dated")), "date_key", "left")

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")))

    rows = dated.agg(
        F.sum("n").alias("transactions"),
        rows_where(F.col("is_flagged") == 1).alias("flagged_transactions"),
        rows_where(F.col("channel").isNotNull()).alias("by_channel"),
        rows_where(F.col("transaction_type").isNotNull()).alias("by_type"),
        rows_where(F.col("transaction_hour").between(0, 23)).alias("by_hour"),
        rows_where(F.col("dated") == 1).alias("by_month"),
    )
    active = star.fact.select("customer_key").distinct().select(F.lit(0).alias("in_tier"), F.lit(1).alias("n"))
    tiers = scoring.risk_tier_summary(star).select(F.lit(1).alias("in_tier"), F.col("customer_count").alias("n"))
    people = active.unionByName(tiers).agg(
        F.sum(F.when(F.col("in_tier") == 0, F.col("n"))).alias("customers"),
        F.sum(F.when(F.col("in_tier") == 1, F.col("n"))).alias("by_tier"),
    )
    checks = {
        "transactions": [
            ("transactions by channel", F.col("by_channel"), F.col("transactions")),
            ("transactions by hour", F.col("by_hour"), F.col("transactions")),
            ("transactions by month", F.col("by_month"), F.col("transactions")),
            ("transactions by type", F.col("by_type"), F.col("transactions")),
        ],
        "customers": [("customers by risk tier", F.col("by_tier"), F.col("customers"))],
    }
    for name, value in (expected or {}).items():
        subject = "customers" if name == "customers" else "transactions"
        checks[subject].append((f"expected {name}", F.col(name), F.lit(value)))

    def listed(figures: DataFrame, subject: str) -> DataFrame:
        entries = [
            F.struct(
                F.lit(label).alias("check_name"),
                F.coalesce(found, F.lit(0)).cast("bigint").alias("found"),
                F.coalesce(wanted, F.lit(0)).cast("bigint").alias("wanted"),
            )
            for label, found, wanted in checks[subject]
        ]
        return figures.select(F.inline(F.array(*entries)))

    return (
        listed(rows, "transactions")
        .unionByName(listed(people, "customers"))
        .withColumn("difference", F.col("found") - F.col("wanted"))
        .withColumn("agrees", (F.col("difference") == 0).cast("int"))
    )
