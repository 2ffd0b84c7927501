"""Anomalies: off-hours activity, rapid repeats, amount outliers, spike days, cross-country use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.functions.labels import compared, labelled
from ledgerlens.functions.measures import MOMENTS, moments
from ledgerlens.operators.hot_keys import join_per_key
from ledgerlens.operators.ranking import top
from ledgerlens.operators.rollup import key_parts, summarise, summarise_parts
from ledgerlens.operators.velocity import MINUTE, closest_pairs, pair_order, velocity_leaders
from ledgerlens.plans.baseline import USUAL, distinct_customers
from ledgerlens.session import write_table
from ledgerlens.sources.star import Star


def off_hours_by_hour(star: Star) -> DataFrame:
    rows = star.fact.filter(F.col("is_off_hours") == 1)
    return summarise(rows, ["transaction_hour"], USUAL, distinct_customers()).orderBy(
        F.col("flagged_percentage").desc()
    )


def off_hours_vs_normal(star: Star) -> DataFrame:
    period = labelled(F.col("is_off_hours") == 1, "Off-Hours (1AM-4AM)", "Normal Hours")
    rows = star.fact.withColumn("time_period", period)
    names = USUAL + ("max_transaction_usd",)
    return summarise(rows, ["time_period"], names, distinct_customers()).orderBy("time_period")


def off_hours_by_channel(star: Star) -> DataFrame:
    rows = star.fact.filter(F.col("is_off_hours") == 1)
    return (
        summarise(rows, ["channel"], USUAL)
        .withColumnRenamed("total_transactions", "off_hours_transactions")
        .orderBy(F.col("flagged_percentage").desc())
    )


def _flagged(star: Star) -> DataFrame:
    return star.fact.filter(F.col("is_flagged") == 1)


def velocity_pairs_top(star: Star, count: int = 50) -> DataFrame:
    pairs = closest_pairs(_flagged(star), star.account, star.customer, count)
    named = pairs.join(star.account.select("account_key", "account_id"), "account_key").join(
        star.customer.select("customer_key", "full_name", "customer_segment"), "customer_key"
    )
    gap = F.col("second_instant") - F.col("first_instant")
    return top(named, count, *pair_order()).select(
        "account_key",
        "account_id",
        "full_name",
        "customer_segment",
        F.col("first_transaction_id").alias("first_txn"),
        F.col("second_transaction_id").alias("second_txn"),
        F.col("first_transaction_datetime").alias("first_txn_time"),
        F.col("second_transaction_datetime").alias("second_txn_time"),
        F.floor(gap / F.lit(MINUTE)).cast("bigint").alias("minutes_apart"),
        F.col("first_amount_usd").cast("double").alias("first_amount"),
        F.col("second_amount_usd").cast("double").alias("second_amount"),
        (F.col("first_amount_usd") + F.col("second_amount_usd")).cast("double").alias("combined_amount"),
        "channel",
    )


def velocity_account_summary(star: Star, count: int = 20) -> DataFrame:
    leaders = velocity_leaders(_flagged(star), F.col("is_flagged") == 1)
    per_account = leaders.groupBy("account_key", "customer_key").agg(
        F.sum("pairs").alias("hits"),
        F.sum("paid_pairs").alias("paid"),
        F.sum("pair_cents").cast(exact.WHOLE).alias("cents"),
        F.max("instant").alias("last_instant"),
    )
    keys = ["account_key", "account_id", "full_name", "customer_segment"]
    named = (
        per_account.join(star.account.select("account_key", "account_id"), "account_key")
        .join(star.customer.select("customer_key", "full_name", "customer_segment"), "customer_key")
        .groupBy(*keys)
        .agg(
            F.sum("hits").alias("velocity_hits"),
            F.sum("paid").alias("paid"),
            F.sum("cents").cast(exact.WHOLE).alias("cents"),
            F.max("last_instant").alias("last_instant"),
        )
    )
    mean = exact.mean_hundredths(F.col("cents"), F.col("paid"))
    order = [F.col("velocity_hits").desc(), "account_key", "full_name", "customer_segment"]
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (F.col("last_instant").cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    return top(named, count, *order).select(
        *keys,
        "velocity_hits",
        F.when(F.col("paid") > 0, F.col("cents").cast("double") / F.lit(100.0)).alias("total_value_usd"),
        (mean / F.lit(100.0)).alias("average_amount_usd"),
        (start + F.make_dt_interval(secs=seconds)).alias("last_seen"),
    )


def amount_outliers(star: Star, count: int = 50) -> DataFrame:
    """Rows at or above their customer's rounded mean plus three rounded deviations.

    The rows are chosen on their keys and amount alone; the other columns are fetched for the chosen ones.
    """
    parts = key_parts(star.fact, ["customer_key"], ("spend_volatility",))
    amounts, total, squares = moments(*map(F.col, MOMENTS))
    usual = write_table(
        parts.select(
            "customer_key",
            "p_amounts",
            exact.mean_hundredths(total, amounts).cast("bigint").alias("mean"),
            exact.deviation_hundredths(amounts, total, squares).alias("deviation"),
        ),
        "customer-amounts",
    )
    keys = ["customer_key", "transaction_key", "amount_usd"]
    cents = exact.hundredths(F.col("amount_usd"))
    far = (
        join_per_key(star.fact.select(*keys), usual, "customer_key", "p_amounts", ["transaction_key"])
        .filter(cents >= F.col("mean") + 3 * F.col("deviation"))
        .withColumn("times_above_average", exact.ratio(cents, F.col("mean")))
    )
    order = [F.col("times_above_average").desc_nulls_last(), F.col("transaction_key"), F.col("amount_usd")]
    named = far.join(star.customer.select("customer_key"), "customer_key")
    # At most `count` rows, hence small enough to broadcast; rows of the fact that are equal in these keys rank equal.
    chosen = F.broadcast(top(named, count, *order).dropDuplicates(keys)).alias("chosen")
    rows = star.fact.select(*keys, "transaction_id", "transaction_datetime", "channel", "transaction_type", "is_flagged")
    found = (
        rows.join(chosen, reduce(Column.__and__, [rows[key].eqNullSafe(F.col(f"chosen.{key}")) for key in keys]))
        .select(*[rows[name] for name in rows.columns], "mean", "deviation", "times_above_average")
        .join(star.customer.select("customer_key", "full_name", "customer_segment"), "customer_key")
    )
    return top(found, count, *order).select(
        "transaction_id",
        "customer_key",
        "full_name",
        "customer_segment",
        "transaction_datetime",
        "channel",
        "transaction_type",
        F.col("amount_usd").cast("double").alias("transaction_amount"),
        (F.col("mean") / F.lit(100.0)).alias("customer_average_amount"),
        (F.col("deviation") / F.lit(100.0)).alias("standard_deviation_amount"),
        "times_above_average",
        "is_flagged",
    )


def daily_spikes(star: Star) -> DataFrame:
    """Days with more transactions than the rounded daily mean plus two rounded deviations."""
    days = exact.with_cents(star.fact).groupBy("transaction_date").agg(
        F.count(F.lit(1)).alias("daily_txn_count"),
        exact.total_hundredths(*exact.value_sums(F.col("row_cents"))).alias("cents"),
        F.sum("is_flagged").alias("daily_flagged"),
    )
    # One row per calendar day reaches this window.
    all_days = Window.partitionBy()
    scaled = F.col("daily_txn_count") * 100
    big = scaled.cast("decimal(19,0)")
    counted = days.select(
        "*",
        F.count(F.lit(1)).over(all_days).alias("days"),
        F.sum(big).over(all_days).alias("total"),
        F.sum((big * big).cast(exact.WHOLE)).over(all_days).alias("squares"),
    )
    stats = counted.withColumns(
        {
            "mean": exact.mean_hundredths(F.col("total"), F.col("days")).cast("bigint"),
            "deviation": exact.deviation_hundredths(F.col("days"), F.col("total"), F.col("squares")),
        }
    )
    return (
        stats.filter(scaled > F.col("mean") + 2 * F.col("deviation"))
        .select(
            "transaction_date",
            "daily_txn_count",
            (F.col("cents").cast("double") / F.lit(100.0)).alias("daily_value"),
            "daily_flagged",
            (F.col("mean") / F.lit(100.0)).alias("avg_daily_txns"),
            exact.ratio(scaled, F.col("mean")).alias("times_above_avg"),
        )
        .orderBy(F.col("daily_txn_count").desc())
    )


def _home(star: Star, *columns: str) -> DataFrame:
    return star.customer.select("customer_key", *columns, F.col("country").alias("home_country"))


def _abroad(collation: str | None = None) -> Column:
    return compared(F.col("home_country"), collation) != compared(F.col("country"), collation)


def geo_mismatch_transactions(star: Star, count: int = 50, collation: str | None = None) -> DataFrame:
    """Transactions outside the customer's home country; countries are compared by `collation`.

    The rows are chosen on their keys, risk and amount alone; the other columns are fetched for the chosen ones.
    """
    places = star.location.select("location_key", "country", "is_high_risk_country")
    rows = star.fact.select("transaction_key", "customer_key", "location_key", "amount_usd")
    away = rows.join(places, "location_key").join(_home(star), "customer_key").filter(_abroad(collation))
    order = [
        F.col("is_high_risk_country").desc(),
        F.col("amount_usd").desc_nulls_last(),
        F.col("transaction_key"),
    ]
    # At most `count` rows, hence small enough to broadcast.
    chosen = F.broadcast(
        top(away, count, *order).select("transaction_key", "customer_key", "location_key", "home_country", "country")
    )
    details = star.fact.select(
        "transaction_key", "transaction_id", "customer_key", "location_key",
        "transaction_datetime", "amount_usd", "channel", "is_flagged",
    )
    found = (
        details.join(chosen, ["transaction_key", "customer_key", "location_key"])
        .join(star.location.select("location_key", "city", "is_high_risk_country"), "location_key")
        .join(star.customer.select("customer_key", "customer_id", "full_name"), "customer_key")
    )
    return top(found, count, *order).select(
        "transaction_id",
        "customer_id",
        "full_name",
        "home_country",
        F.col("country").alias("transaction_country"),
        F.col("city").alias("transaction_city"),
        "is_high_risk_country",
        "transaction_datetime",
        F.col("amount_usd").cast("double").alias("amount_usd"),
        "channel",
        "is_flagged",
    )


def geo_mismatch_by_customer(star: Star, count: int = 20, collation: str | None = None) -> DataFrame:
    """Customers by transactions outside their home country; countries are compared, and told apart, by `collation`."""
    names = ("total_transactions", "total_value_usd", "flagged_count")
    places = star.location.select("location_key", "country", "is_high_risk_country")
    away = (
        key_parts(star.fact, ["customer_key", "location_key"], names)
        .join(places, "location_key")
        .join(_home(star, "customer_id", "full_name"), "customer_key")
        .filter(_abroad(collation))
    )
    keys = ["customer_id", "full_name", "home_country"]
    extra = {
        "countries_transacted_in": F.countDistinct(compared(F.col("country"), collation)),
        "high_risk_country_hits": F.sum(F.col("is_high_risk_country") * F.col("p_rows")),
    }
    groups = summarise_parts(away, keys, names, extra).withColumnRenamed("total_transactions", "mismatch_txn_count")
    return top(groups, count, F.col("high_risk_country_hits").desc(), F.col("mismatch_txn_count").desc(), *keys)


def geo_mismatch_total(star: Star, collation: str | None = None) -> DataFrame:
    """How many transactions took place outside the customer's home country; countries are compared by `collation`."""
    places = star.location.select("location_key", "country")
    cells = key_parts(star.fact, ["customer_key", "location_key"], ("total_transactions",))
    away = cells.join(places, "location_key").join(_home(star), "customer_key").filter(_abroad(collation))
    return away.agg(F.coalesce(F.sum("p_rows"), F.lit(0)).alias("geo_mismatches"))
