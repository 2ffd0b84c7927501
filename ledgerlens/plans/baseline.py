"""Baseline key figures: volume, value and flagged share by time, place, channel and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.functions.labels import WEEKDAYS, labelled, place_in
from ledgerlens.operators.ranking import top
from ledgerlens.operators.rollup import summarise, summarise_by_dimension
from ledgerlens.sources.star import Star

USUAL = ("total_transactions", "total_value_usd", "average_amount_usd", "flagged_count", "flagged_percentage")
UNIQUE_CUSTOMERS = "unique_customers"
DISTINCT_CUSTOMERS = {UNIQUE_CUSTOMERS: "customer_key"}


def distinct_customers() -> dict:
    return {UNIQUE_CUSTOMERS: F.countDistinct("customer_key")}


def by_value(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.col("total_value_usd").desc_nulls_last())


def overall_summary(star: Star) -> DataFrame:
    return summarise(
        star.fact,
        [],
        ("total_transactions", "total_value_usd", "average_amount_usd", "min_transaction_usd",
         "max_transaction_usd", "flagged_count", "flagged_percentage"),
    )


def monthly_trend(star: Star) -> DataFrame:
    months = star.date.select("date_key", "year_number", "month_number", "month_name")
    keys = ["year_number", "month_number", "month_name"]
    return summarise_by_dimension(star.fact, months, "date_key", keys, USUAL).orderBy("year_number", "month_number")


def channel_breakdown(star: Star) -> DataFrame:
    return by_value(summarise(star.fact, ["channel"], USUAL))


def transaction_type_breakdown(star: Star) -> DataFrame:
    return by_value(summarise(star.fact, ["transaction_type"], USUAL))


def status_breakdown(star: Star) -> DataFrame:
    names = ("total_transactions", "total_value_usd", "flagged_percentage")
    return summarise(star.fact, ["status"], names).orderBy(F.col("total_transactions").desc())


def hourly_distribution(star: Star) -> DataFrame:
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage")
    return summarise(star.fact, ["transaction_hour"], names).orderBy("transaction_hour")


def segment_breakdown(star: Star) -> DataFrame:
    segments = star.customer.select("customer_key", "customer_segment")
    return by_value(
        summarise_by_dimension(
            star.fact, segments, "customer_key", ["customer_segment"], USUAL, distinct_customers()
        )
    )


def weekend_vs_weekday(star: Star) -> DataFrame:
    days = star.date.select(
        "date_key", labelled(F.col("is_weekend") == 1, "Weekend", "Weekday").alias("day_type")
    )
    return summarise_by_dimension(star.fact, days, "date_key", ["day_type"], USUAL).orderBy("day_type")


def day_of_week_breakdown(star: Star) -> DataFrame:
    days = star.date.select("date_key", "day_of_week", "is_weekend")
    return summarise_by_dimension(star.fact, days, "date_key", ["day_of_week", "is_weekend"], USUAL).orderBy(
        place_in(F.col("day_of_week"), WEEKDAYS)
    )


def country_breakdown(star: Star) -> DataFrame:
    places = star.location.select("location_key", "country", "region")
    return by_value(
        summarise_by_dimension(
            star.fact, places, "location_key", ["country", "region"], USUAL, distinct=DISTINCT_CUSTOMERS
        )
    )


def city_hotspots(star: Star, count: int = 20) -> DataFrame:
    places = star.location.select("location_key", "country", "city")
    cities = summarise_by_dimension(star.fact, places, "location_key", ["country", "city"], USUAL)
    return top(cities, count, F.col("flagged_count").desc(), "country", "city")


def high_risk_country_activity(star: Star) -> DataFrame:
    risky = star.location.filter(F.col("is_high_risk_country") == 1).select("location_key", "country", "city")
    rows = star.fact.join(risky.select("location_key"), "location_key", "left_semi")
    return by_value(
        summarise_by_dimension(
            rows, risky, "location_key", ["country", "city"], USUAL, distinct=DISTINCT_CUSTOMERS
        )
    )


def high_risk_country_share(star: Star) -> DataFrame:
    risk = labelled(F.col("is_high_risk_country") == 1, "High Risk Country", "Normal Country")
    places = star.location.select("location_key", risk.alias("country_risk"))
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage")
    value = {"value": exact.total_hundredths(F.sum("p_units"), F.sum("p_cents"))}
    shares = summarise_by_dimension(star.fact, places, "location_key", ["country_risk"], names, value)
    # Two rows at most reach this window.
    whole = F.sum("value").over(Window.partitionBy())
    return (
        shares.withColumn("percentage_of_total_value", exact.percent(F.col("value"), whole))
        .drop("value")
        .orderBy("country_risk")
    )


def account_type_breakdown(star: Star) -> DataFrame:
    accounts = star.account.select("account_key", "account_type", "balance_tier")
    names = USUAL + ("max_transaction_usd",)
    return summarise_by_dimension(
        star.fact,
        accounts,
        "account_key",
        ["account_type", "balance_tier"],
        names,
        distinct=DISTINCT_CUSTOMERS
    ).orderBy(F.col("average_amount_usd").desc())
