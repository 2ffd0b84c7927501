"""Merchant and channel risk: rankings, shell merchants, trends and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.functions.labels import RISKY_RATINGS
from ledgerlens.operators.ranking import running_total_by_value, top
from ledgerlens.operators.rollup import key_parts, summarise, summarise_by_dimension, summarise_parts
from ledgerlens.plans.baseline import DISTINCT_CUSTOMERS, USUAL, by_value, distinct_customers
from ledgerlens.session import write_table
from ledgerlens.sources.star import Star

SHELL_WEIGHT = 20


def _merchants(star: Star, *columns: str) -> DataFrame:
    return star.merchant.withColumn("merchant_country", F.col("country")).select("merchant_key", *columns)


def _weighted_shares(flagged_weight: int, off_hours_weight: int, fixed: Column) -> Column:
    """Flagged and off-hours shares by weight plus a fixed part, rounded once at the end."""
    rows = F.col("total_transactions")
    weighted = F.col("flagged_count") * flagged_weight + F.col("off_hours_count") * off_hours_weight
    return exact.ratio(weighted + fixed * rows, rows)


def merchant_overview(star: Star) -> DataFrame:
    keys = ["merchant_name", "merchant_category", "risk_rating", "merchant_country", "is_shell_merchant"]
    names = USUAL + ("max_transaction_usd", "off_hours_count")
    return summarise_by_dimension(
        star.fact, _merchants(star, *keys), "merchant_key", keys, names, distinct=DISTINCT_CUSTOMERS
    ).orderBy(F.col("flagged_percentage").desc())


def merchant_risk_ranking(star: Star) -> DataFrame:
    keys = ["merchant_name", "merchant_category", "risk_rating", "is_shell_merchant"]
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage",
             "off_hours_count", "off_hours_percentage")
    groups = summarise_by_dimension(star.fact, _merchants(star, *keys), "merchant_key", keys, names)
    score = _weighted_shares(50, 30, F.col("is_shell_merchant") * SHELL_WEIGHT)
    return groups.withColumn("merchant_risk_score", score).orderBy(F.col("merchant_risk_score").desc())


def shell_merchants(star: Star) -> DataFrame:
    keys = ["merchant_name", "merchant_category", "merchant_country", "risk_rating"]
    shells = _merchants(star, *keys, "is_shell_merchant").filter(F.col("is_shell_merchant") == 1)
    rows = star.fact.join(shells.select("merchant_key"), "merchant_key", "left_semi")
    return by_value(
        summarise_by_dimension(rows, shells, "merchant_key", keys, USUAL, distinct=DISTINCT_CUSTOMERS)
    )


def shell_transaction_total(star: Star) -> DataFrame:
    shells = star.merchant.filter(F.col("is_shell_merchant") == 1).select("merchant_key")
    parts = key_parts(star.fact, ["merchant_key"], ("total_transactions",))
    return parts.join(shells, "merchant_key").agg(
        F.coalesce(F.sum("p_rows"), F.lit(0)).alias("shell_merchant_transactions")
    )


def merchant_category_summary(star: Star) -> DataFrame:
    """Two distinct counts per category, each over rows already collapsed to its own key."""
    names = USUAL + ("off_hours_count", "off_hours_percentage")
    categories = _merchants(star, "merchant_category")
    groups = summarise_by_dimension(
        star.fact, categories, "merchant_key", ["merchant_category"], names, distinct=DISTINCT_CUSTOMERS
    )
    used = star.fact.select("merchant_key").distinct()
    merchants = (
        used.join(_merchants(star, "merchant_category", "merchant_name"), "merchant_key")
        .groupBy(F.col("merchant_category").alias("category"))
        .agg(F.countDistinct("merchant_name").alias("merchant_count"))
    )
    same = F.col("merchant_category").eqNullSafe(F.col("category"))
    return groups.join(merchants, same).drop("category").orderBy(F.col("flagged_percentage").desc())


def channel_risk_score(star: Star) -> DataFrame:
    names = USUAL + ("max_transaction_usd", "off_hours_count", "off_hours_percentage")
    channels = summarise(star.fact, ["channel"], names, distinct_customers())
    score = _weighted_shares(60, 40, F.lit(0))
    return channels.withColumn("channel_risk_score", score).orderBy(F.col("channel_risk_score").desc())


def channel_monthly_trend(star: Star, with_year: bool = False) -> DataFrame:
    """Months are told apart by number alone unless `with_year` is set."""
    year = ["year_number"] if with_year else []
    keys = ["channel", *year, "month_name", "month_number", "quarter"]
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage")
    months = star.date.select(
        "date_key", "year_number", "month_name", "month_number", F.col("quarter_number").alias("quarter")
    )
    return summarise_by_dimension(star.fact, months, "date_key", keys, names, also_by=("channel",)).orderBy(
        "channel", *year, "month_number"
    )


def merchant_customer_overlap(star: Star, count: int = 30) -> DataFrame:
    merchant = ["merchant_name", "merchant_category", "risk_rating", "is_shell_merchant"]
    customer = ["customer_id", "full_name", "customer_segment", "kyc_status"]
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage")
    risky = _merchants(star, *merchant).filter(
        F.col("risk_rating").isin(RISKY_RATINGS) | (F.col("is_shell_merchant") == 1)
    )
    rows = star.fact.join(risky.select("merchant_key"), "merchant_key", "left_semi")
    parts = (
        key_parts(rows, ["merchant_key", "customer_key"], names)
        .join(risky, "merchant_key")
        .join(star.customer.select("customer_key", *customer), "customer_key")
    )
    groups = (
        summarise_parts(parts, merchant + customer, names)
        .withColumnRenamed("total_transactions", "transactions_together")
        .filter(F.col("flagged_count") > 0)
    )
    ties = ["merchant_name", "customer_id", *merchant[1:], *customer[1:]]
    return top(groups, count, F.col("flagged_count").desc(), F.col("total_value_usd").desc(), *ties)


def merchant_concentration(star: Star, count: int = 20) -> DataFrame:
    keys = ["merchant_name", "merchant_category", "risk_rating"]
    names = ("flagged_count", "total_value_usd")
    # Stored, as it is read three times: for its first rows, its value masses and its total.
    merchants = write_table(
        summarise_by_dimension(star.fact, _merchants(star, *keys), "merchant_key", keys, names), "merchant-flags"
    )
    first = top(merchants, count, F.col("flagged_count").desc(), *keys)
    running = running_total_by_value(merchants, "flagged_count", count, "running").withColumnRenamed(
        "flagged_count", "running_at"
    )
    total = merchants.agg(F.sum("flagged_count")).scalar()
    return (
        # At most `count` rows; merchants whose flags are all missing come last, with the full total.
        first.join(F.broadcast(running), F.col("flagged_count").eqNullSafe(F.col("running_at")))
        .select(
            *keys,
            "flagged_count",
            "total_value_usd",
            exact.percent(F.col("flagged_count"), total).alias("percentage_of_all_fraud"),
            exact.percent(F.col("running"), total).alias("cumulative_fraud_percentage"),
        )
        .orderBy(F.col("flagged_count").desc(), *keys)
    )
