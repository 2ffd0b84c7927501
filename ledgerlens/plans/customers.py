"""Customer risk profiles: baselines, watchlists, channel switches, spend spikes, dormancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.functions.labels import POOR_KYC, compared, labelled
from ledgerlens.operators.ranking import top
from ledgerlens.operators.rollup import key_parts, summarise_by_dimension, summarise_parts
from ledgerlens.sources.star import Star


def _profile(star: Star, *columns: str) -> DataFrame:
    return star.customer.withColumn("home_country", F.col("country")).select("customer_key", *columns)


def customer_baseline(star: Star, count: int = 50) -> DataFrame:
    keys = ["customer_id", "full_name", "customer_segment", "home_country", "kyc_status", "preferred_channel"]
    names = (
        "total_transactions", "total_value_usd", "average_amount_usd", "max_transaction_usd", "spend_volatility",
        "flagged_count", "flagged_percentage", "off_hours_count", "off_hours_percentage",
        "first_transaction", "last_transaction",
    )
    groups = summarise_by_dimension(
        star.fact, _profile(star, *keys), "customer_key", keys, names, distinct={"accounts_used": "account_key"}
    )
    return top(groups, count, F.col("flagged_count").desc(), *keys)


def high_risk_customers(star: Star, count: int = 30) -> DataFrame:
    keys = ["customer_id", "full_name", "customer_segment", "kyc_status", "home_country"]
    names = (
        "total_transactions", "total_value_usd", "average_amount_usd", "flagged_count", "flagged_percentage",
        "off_hours_count", "off_hours_percentage",
    )
    groups = summarise_by_dimension(star.fact, _profile(star, *keys), "customer_key", keys, names)
    risky = groups.filter((F.col("flagged_percentage") > 20) & (F.col("total_transactions") >= 5))
    return top(risky, count, F.col("flagged_percentage").desc(), F.col("total_value_usd").desc(), *keys)


def unusual_channel_use(star: Star, count: int = 30, collation: str | None = None) -> DataFrame:
    """What customers do on another channel than the preferred one; channels are compared by `collation`."""
    profile = ["customer_id", "full_name", "preferred_channel"]
    keys = profile + ["channel"]
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage")
    parts = key_parts(star.fact, ["customer_key", "channel"], names)
    unlike = compared(F.col("channel"), collation) != compared(F.col("preferred_channel"), collation)
    pattern = labelled(unlike, "Unusual Channel", "Normal Channel")
    used = parts.join(_profile(star, *profile), "customer_key").withColumn("channel_pattern", pattern)
    unusual = used.filter(F.col("channel_pattern") == "Unusual Channel")
    groups = summarise_parts(unusual, keys + ["channel_pattern"], names).withColumnRenamed(
        "total_transactions", "transaction_count"
    )
    first = top(groups, count, F.col("flagged_count").desc(), F.col("total_value_usd").desc(), *keys)
    return first.withColumnRenamed("channel", "channel_used")


def quarter_spend_spike(star: Star, count: int = 30, with_year: bool = False) -> DataFrame:
    """Third-quarter months whose spend is above twice the customer's average month of the first half.

    Months without activity are not averaged in; a customer without any
    first-half month has no baseline. Months and baselines are told apart by
    year only if `with_year` is set, which also adds the year.
    """
    year = ["year_number"] if with_year else []
    months = star.date.select("date_key", *year, "month_number", "month_name", "quarter_number")
    monthly = (
        exact.with_cents(star.fact).join(months, "date_key")
        .groupBy("customer_key", *year, "month_number", "month_name", "quarter_number")
        .agg(
            exact.total_hundredths(*exact.value_sums(F.col("row_cents"))).alias("cents"),
            F.count(F.lit(1)).alias("monthly_txn_count"),
            F.sum("is_flagged").alias("monthly_flagged"),
        )
    )
    # A customer has one row per month, so the window group is a dozen rows.
    per_customer = Window.partitionBy("customer_key", *year)
    first_half = F.when(F.col("quarter_number").isin(1, 2), F.col("cents"))
    baseline = exact.mean_hundredths(F.sum(first_half).over(per_customer), F.count(first_half).over(per_customer))
    spikes = (
        monthly.withColumn("baseline", baseline)
        .filter((F.col("quarter_number") == 3) & (F.col("cents") > F.col("baseline") * 2))
        .withColumn("spend_multiplier", exact.ratio(F.col("cents"), F.col("baseline")))
        .join(_profile(star, "customer_id", "full_name", "customer_segment"), "customer_key")
    )
    order = [F.col("spend_multiplier").desc_nulls_last(), "customer_key", *year, "month_number"]
    return top(spikes, count, *order).select(
        "customer_id",
        "full_name",
        "customer_segment",
        *year,
        "month_name",
        F.col("quarter_number").alias("quarter"),
        (F.col("cents").cast("double") / F.lit(100.0)).alias("monthly_spend"),
        "monthly_txn_count",
        "monthly_flagged",
        (F.col("baseline") / F.lit(100.0)).alias("q1_q2_baseline_spend"),
        "spend_multiplier",
    )


def _returns(days: DataFrame, gap: int) -> DataFrame:
    """Customer days that follow the customer's previous day by `gap` days or more.

    `days` holds one row per customer and day, so a window group is bounded by
    the calendar however many transactions a customer has.
    """
    previous = F.lag("transaction_date").over(Window.partitionBy("customer_key").orderBy("transaction_date"))
    return (
        days.withColumn("previous_transaction_date", previous)
        .withColumn("days_dormant", F.datediff("transaction_date", "previous_transaction_date"))
        .filter(F.col("days_dormant") >= gap)
    )


def dormant_reactivation(star: Star, gap: int = 60, count: int = 30) -> DataFrame:
    """The first transaction after a pause; only the first row of a return date can carry a gap.

    Days with a pause before them are found on customers and dates alone. They
    are few, and only the rows of these days are compared.
    """
    days = star.fact.select("customer_key", "transaction_date").distinct()
    pauses = _returns(days, gap)
    columns = ["transaction_datetime", "transaction_key", "amount_usd", "channel", "is_flagged"]
    rows = star.fact.select("customer_key", "transaction_date", *columns)
    first = (
        rows.join(pauses, ["customer_key", "transaction_date"])
        .groupBy("customer_key", "transaction_date", "previous_transaction_date", "days_dormant")
        .agg(F.min(F.struct(*columns)).alias("first"))
    )
    back = first.join(_profile(star, "customer_id", "full_name", "customer_segment", "kyc_status"), "customer_key")
    order = [
        F.col("days_dormant").desc(),
        F.col("first.amount_usd").desc_nulls_last(),
        F.col("first.transaction_key"),
    ]
    return top(back, count, *order).select(
        "customer_id",
        "full_name",
        "customer_segment",
        "kyc_status",
        "previous_transaction_date",
        F.col("transaction_date").alias("return_date"),
        F.col("days_dormant").cast("bigint").alias("days_dormant"),
        F.col("first.amount_usd").cast("double").alias("return_transaction_amount"),
        F.col("first.channel").alias("channel"),
        F.col("first.is_flagged").alias("is_flagged"),
    )


def dormant_customer_total(star: Star, gap: int = 60) -> DataFrame:
    days = star.fact.select("customer_key", "transaction_date").distinct()
    back = _returns(days, gap).select("customer_key").distinct()
    return back.join(_profile(star), "customer_key", "left_semi").agg(
        F.count(F.lit(1)).alias("dormant_reactivations")
    )


def kyc_breakdown(star: Star) -> DataFrame:
    names = ("total_transactions", "total_value_usd", "average_amount_usd", "max_transaction_usd",
             "flagged_count", "flagged_percentage")
    return summarise_by_dimension(
        star.fact,
        _profile(star, "customer_id", "kyc_status"),
        "customer_key",
        ["kyc_status"],
        names,
        {"unique_customers": F.countDistinct("customer_id")},
    ).orderBy(F.col("flagged_percentage").desc())


def customer_watchlist(star: Star, count: int = 20, collation: str | None = None) -> DataFrame:
    """Customers by flags, mismatches and high-risk countries; countries and KYC states are compared by `collation`."""
    keys = ["customer_id", "full_name", "customer_segment", "kyc_status", "home_country"]
    names = ("total_transactions", "total_value_usd", "flagged_count", "flagged_percentage", "off_hours_count")
    places = star.location.select("location_key", "country", "is_high_risk_country")
    parts = (
        key_parts(star.fact, ["customer_key", "location_key"], names)
        .join(places, "location_key")
        .join(_profile(star, *keys), "customer_key")
    )
    abroad = compared(F.col("home_country"), collation) != compared(F.col("country"), collation)
    poor = [compared(F.lit(status), collation) for status in POOR_KYC]
    extra = {
        "geo_mismatch_count": F.sum(F.when(abroad, F.col("p_rows")).otherwise(0)),
        "high_risk_country_hits": F.sum(F.when(F.col("is_high_risk_country") == 1, F.col("p_rows")).otherwise(0)),
    }
    groups = summarise_parts(parts, keys, names, extra).withColumn(
        "poor_kyc", labelled(compared(F.col("kyc_status"), collation).isin(poor), "YES", "NO")
    )
    order = [F.col(c).desc() for c in ("flagged_count", "geo_mismatch_count", "high_risk_country_hits")]
    return top(groups, count, *order, *keys)
