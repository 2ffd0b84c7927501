"""The tables a risk dashboard reads: key-figure cards, chart series and the watchlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.functions.labels import CHANNELS, POOR_KYC, RISK_TIERS, labelled, place_in
from ledgerlens.operators.ranking import top
from ledgerlens.operators.rollup import key_parts, summarise, summarise_by_dimension
from ledgerlens.plans import anomalies, baseline, customers, merchants, scoring
from ledgerlens.sources.star import Star

HOURS = 24


def kpi_cards(star: Star, quarter: int | None = None, channel: str | None = None) -> DataFrame:
    """Transactions, value, flagged share and the value of flagged rows, for a quarter and a channel or all."""
    rows = star.fact
    if channel is not None:
        rows = rows.filter(F.col("channel") == channel)
    if quarter is not None:
        days = star.date.filter(F.col("quarter_number") == quarter).select("date_key")
        rows = rows.join(days, "date_key", "left_semi")
    units, rest = exact.value_sums(F.when(F.col("is_flagged") == 1, F.col("row_cents")))
    suspicious = exact.total_hundredths(units, rest).cast("double") / F.lit(100.0)
    names = ("total_transactions", "total_value_usd", "flagged_percentage")
    return summarise(rows, [], names, {"suspicious_value_usd": suspicious})


def monthly_volume(star: Star) -> DataFrame:
    return baseline.monthly_trend(star).select(
        "year_number", "month_number", "month_name", "total_transactions", "flagged_count"
    )


def flagged_pct_by_channel(star: Star) -> DataFrame:
    channels = summarise(star.fact, ["channel"], ("flagged_percentage",))
    return channels.orderBy(F.col("flagged_percentage").desc())


def monthly_kpi_banded(star: Star) -> DataFrame:
    names = ("total_transactions", "total_value_usd", "flagged_count")
    months = star.date.select("date_key", "year_number", "month_number", "month_name")
    keys = ["year_number", "month_number", "month_name"]
    share = exact.percent(F.col("flagged_count"), F.col("total_transactions"), digits=1)
    band = F.when(F.col("flagged_percentage") > 10, "red").when(F.col("flagged_percentage") > 5, "amber")
    return (
        summarise_by_dimension(star.fact, months, "date_key", keys, names)
        .withColumn("flagged_percentage", share)
        .withColumn("band", band.otherwise("green"))
        .orderBy("year_number", "month_number")
    )


def segment_value_share(star: Star) -> DataFrame:
    segments = star.customer.select("customer_key", "customer_segment")
    value = {"value": exact.total_hundredths(F.sum("p_units"), F.sum("p_cents"))}
    shares = summarise_by_dimension(
        star.fact, segments, "customer_key", ["customer_segment"], ("total_value_usd",), value
    )
    # One row per segment reaches this window.
    whole = F.sum("value").over(Window.partitionBy())
    share = exact.percent(F.col("value"), whole)
    return baseline.by_value(shares.withColumn("percentage_of_total_value", share).drop("value"))


def off_hours_kpis(star: Star) -> DataFrame:
    night = F.col("is_off_hours") == 1
    flagged = F.col("is_flagged")
    counts = star.fact.agg(
        F.count(F.when(night, 1)).alias("off_hours_transactions"),
        F.sum(F.when(night, flagged)).alias("night_flagged"),
        F.count(F.when(night, None).otherwise(1)).alias("normal_rows"),
        F.sum(F.when(night, None).otherwise(flagged)).alias("normal_flagged"),
    )
    return counts.select(
        "off_hours_transactions",
        exact.percent(F.col("night_flagged"), F.col("off_hours_transactions")).alias("off_hours_flagged_percentage"),
        exact.percent(F.col("normal_flagged"), F.col("normal_rows")).alias("normal_flagged_percentage"),
    )


def geo_mismatch_total(star: Star) -> DataFrame:
    return anomalies.geo_mismatch_total(star)


def shell_txn_total(star: Star) -> DataFrame:
    return merchants.shell_transaction_total(star)


def hour_flag_histogram(star: Star) -> DataFrame:
    """All 24 hours, with zeros where nothing happened."""
    counts = star.fact.groupBy("transaction_hour").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_flagged").alias("flagged")
    )
    hours = star.spark.range(HOURS, numPartitions=1).select(F.col("id").cast("int").alias("transaction_hour"))
    flagged = F.coalesce("flagged", F.lit(0))
    return (
        hours.join(counts, "transaction_hour", "left")
        .select(
            "transaction_hour",
            flagged.alias("flagged_count"),
            (F.coalesce("rows", F.lit(0)) - flagged).alias("unflagged_count"),
        )
        .orderBy("transaction_hour")
    )


def flagged_pct_by_category(star: Star) -> DataFrame:
    categories = star.merchant.select("merchant_key", "merchant_category")
    return summarise_by_dimension(
        star.fact, categories, "merchant_key", ["merchant_category"], ("flagged_percentage",)
    ).orderBy(F.col("flagged_percentage").desc())


def merchant_risk_table(star: Star, count: int = 6) -> DataFrame:
    keys = ["merchant_name", "merchant_category", "risk_rating", "merchant_country", "is_shell_merchant"]
    profile = star.merchant.withColumn("merchant_country", F.col("country")).select("merchant_key", *keys)
    shares = summarise_by_dimension(star.fact, profile, "merchant_key", keys, ("flagged_percentage",))
    return top(shares, count, F.col("flagged_percentage").desc(), *keys).select(
        "merchant_name",
        "merchant_category",
        labelled(F.col("is_shell_merchant") == 1, "Yes", "No").alias("shell"),
        "risk_rating",
        "flagged_percentage",
    )


def channel_hours_matrix(star: Star) -> DataFrame:
    periods = {"Off-Hours": "off_hours_transactions", "Normal": "normal_transactions"}
    rows = star.fact.withColumn("period", labelled(F.col("is_off_hours") == 1, *periods))
    matrix = rows.groupBy("channel").pivot("period", list(periods)).agg(F.count(F.lit(1)))
    return matrix.select(
        "channel", *[F.coalesce(F.col(p), F.lit(0)).alias(name) for p, name in periods.items()]
    ).orderBy(place_in(F.col("channel"), CHANNELS))


def tier_kpis(star: Star) -> DataFrame:
    tier = F.col("risk_tier")
    return scoring.customer_risk_scores(star).agg(
        F.count(F.when(tier == "CRITICAL", 1)).alias("critical_customers"),
        F.count(F.when(tier == "HIGH", 1)).alias("high_customers"),
    )


def poor_kyc_customers(star: Star) -> DataFrame:
    poor = star.customer.filter(F.col("kyc_status").isin(POOR_KYC))
    return poor.agg(F.countDistinct("customer_id").alias("poor_kyc_customers"))


def dormant_customer_total(star: Star) -> DataFrame:
    return customers.dormant_customer_total(star)


def flagged_pct_by_kyc(star: Star) -> DataFrame:
    statuses = star.customer.select("customer_key", "kyc_status")
    return summarise_by_dimension(
        star.fact, statuses, "customer_key", ["kyc_status"], ("flagged_percentage",)
    ).orderBy(F.col("flagged_percentage").desc())


def tier_distribution(star: Star) -> DataFrame:
    """All five tiers, with zero customers where a tier is empty."""
    tiers = star.spark.range(1).select(F.explode(F.array(*map(F.lit, RISK_TIERS))).alias("risk_tier"))
    counts = scoring.customer_risk_scores(star).groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"))
    return (
        tiers.join(counts, "risk_tier", "left")
        .select("risk_tier", F.coalesce("n", F.lit(0)).alias("customer_count"))
        .orderBy(place_in(F.col("risk_tier"), RISK_TIERS))
    )


def watchlist_top10(star: Star) -> DataFrame:
    return scoring.top_risk_customers(star, 10).select(
        "customer_id", "full_name", "customer_segment", "kyc_status", "flagged_pct",
        "geo_mismatches", "velocity_hits", "composite_risk_score", "risk_tier",
    )


def quarter_change(star: Star) -> DataFrame:
    """Flagged rows per quarter and their change on the quarter before, in percent."""
    quarters = star.date.select("date_key", "year_number", "quarter_number")
    counts = (
        key_parts(star.fact, ["date_key"], ("flagged_count",))
        .join(quarters, "date_key")
        .groupBy("year_number", "quarter_number")
        .agg(F.sum("p_flagged").alias("flagged_count"))
    )
    # Four rows a year reach this window.
    before = F.lag("flagged_count").over(Window.orderBy("year_number", "quarter_number"))
    return (
        counts.withColumn("previous", before)
        .select(
            "year_number",
            "quarter_number",
            "flagged_count",
            exact.percent(F.col("flagged_count") - F.col("previous"), F.col("previous")).alias("change_percentage"),
        )
        .orderBy("year_number", "quarter_number")
    )
