"""The customer risk score: seven signals, a quintile each, one weighted sum and a tier."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.functions.labels import RISK_TIERS, place_in
from ledgerlens.functions.measures import MOMENTS, PARTS, moments
from ledgerlens.operators.hot_keys import broadcast_by_rows, join_per_key
from ledgerlens.operators.ranking import top, with_quantiles
from ledgerlens.operators.velocity import velocity_leaders
from ledgerlens.session import write_result, write_table
from ledgerlens.sources.published import publish, published
from ledgerlens.sources.star import Star

# The weight of each signal's quintile (1 to 5), so that scores run from 20 to 100.
WEIGHTS = {
    "flagged_score": 6,
    "velocity_score": 4,
    "off_hours_score": 3,
    "geo_score": 3,
    "shell_score": 2,
    "high_risk_country_score": 1,
    "outlier_score": 1,
}
TIER_FLOORS = {"CRITICAL": 80, "HIGH": 60, "MEDIUM": 40, "LOW": 20}

# Signal column to quintile column. Shares are held in hundredths of a percent.
SCORES = {
    "flagged_share": "flagged_score",
    "off_hours_share": "off_hours_score",
    "geo_mismatch_count": "geo_score",
    "high_risk_country_count": "high_risk_country_score",
    "shell_share": "shell_score",
    "outlier_txn_count": "outlier_score",
    "velocity_hit_count": "velocity_score",
}


def _share(part: Column, whole: Column) -> Column:
    return exact.round_ratio(part, whole, 10000).cast("bigint")


def _as_percent(share: str, name: str) -> Column:
    return (F.col(share) / F.lit(100.0)).alias(name)


def customer_activity(star: Star, geo: bool = True, shell: bool = True) -> DataFrame:
    """Everything one pass over the fact can say about a customer.

    Rows collapse to customer and location first; location and customer then
    join those cells. Only the shell flag of the merchant meets single rows.
    Dimension keys are unique, so the left joins add no rows.
    """
    rows = exact.with_cents(star.fact)
    grain = ["customer_key"]
    cells = {
        "total_txns": F.count(F.lit(1)),
        "flagged_count": F.sum("is_flagged"),
        "off_hours_count": F.sum("is_off_hours"),
        **{part: PARTS[part].of_rows() for part in MOMENTS},
    }
    sums = {name: F.sum(name) for name in cells}
    if shell:
        flags = star.merchant.select("merchant_key", F.col("is_shell_merchant").alias("shell"), F.lit(1).alias("m"))
        rows = rows.join(broadcast_by_rows(flags), "merchant_key", "left")
        cells["merchant_rows"] = F.count("m")
        cells["shell_rows"] = F.count(F.when(F.col("shell") == 1, 1))
        sums |= {name: F.sum(name) for name in ("merchant_rows", "shell_rows")}
    if geo:
        grain.append("location_key")
        counted = F.col("located") & F.col("known")
        sums["geo_mismatch_count"] = F.sum(
            F.when(counted, F.when(F.col("home") != F.col("place"), F.col("total_txns")).otherwise(0))
        )
        sums["high_risk_country_count"] = F.sum(
            F.when(counted, F.when(F.col("high_risk") == 1, F.col("total_txns")).otherwise(0))
        )
    parts = rows.groupBy(*grain).agg(*[column.alias(name) for name, column in cells.items()])
    if geo:
        places = star.location.select(
            "location_key",
            F.col("country").alias("place"),
            F.col("is_high_risk_country").alias("high_risk"),
            F.lit(True).alias("located"),
        )
        homes = star.customer.select("customer_key", F.col("country").alias("home"), F.lit(True).alias("known"))
        parts = parts.join(places, "location_key", "left").join(broadcast_by_rows(homes), "customer_key", "left")
    return parts.groupBy("customer_key").agg(*[column.alias(name) for name, column in sums.items()])


def _moments() -> tuple[Column, Column, Column]:
    return moments(*map(F.col, MOMENTS))


def flagged_signal(star: Star) -> DataFrame:
    activity = customer_activity(star, geo=False, shell=False)
    return activity.select(
        "customer_key",
        "total_txns",
        "flagged_count",
        exact.percent(F.col("flagged_count"), F.col("total_txns")).alias("flagged_pct"),
        exact.percent(F.col("off_hours_count"), F.col("total_txns")).alias("off_hours_pct"),
    )


def geo_signal(star: Star) -> DataFrame:
    """Customers with at least one row at a known location."""
    activity = customer_activity(star, shell=False)
    return activity.filter(F.col("geo_mismatch_count").isNotNull()).select(
        "customer_key", "geo_mismatch_count", "high_risk_country_count"
    )


def shell_signal(star: Star) -> DataFrame:
    """The share of shell merchants among a customer's rows at known merchants."""
    activity = customer_activity(star, geo=False)
    return activity.filter(F.col("merchant_rows") > 0).select(
        "customer_key", exact.percent(F.col("shell_rows"), F.col("merchant_rows")).alias("shell_txn_pct")
    )


def customer_amount_stats(star: Star) -> DataFrame:
    """Mean, population deviation and mean plus three deviations of a customer's amounts, unrounded."""
    activity = customer_activity(star, geo=False, shell=False)
    count, total, squares = _moments()
    size = F.nullif(count, F.lit(0)).cast("double") * 100.0
    stats = activity.select(
        "customer_key",
        (total.cast("double") / size).alias("avg_amount"),
        (F.sqrt(exact.spread(count, total, squares).cast("double")) / size).alias("stddev_amount"),
    )
    return stats.withColumn("outlier_threshold", F.col("avg_amount") + F.col("stddev_amount") * 3)


def _outliers(star: Star, activity: DataFrame) -> DataFrame:
    """Rows at or above the customer's own limit. `activity` is a stored table."""
    limits = exact.with_outlier_limit(activity, *_moments(), "limit").select("customer_key", "limit", "p_amounts")
    amounts = star.fact.select("customer_key", "transaction_key", "amount_usd")
    beyond = exact.hundredths(F.col("amount_usd")) >= F.col("limit")
    return (
        join_per_key(amounts, limits, "customer_key", "p_amounts", ["transaction_key"])
        .groupBy("customer_key")
        .agg(F.sum(F.when(beyond, 1).otherwise(0)).alias("outlier_txn_count"))
    )


def amount_signal(star: Star) -> DataFrame:
    activity = write_table(customer_activity(star, geo=False, shell=False), "customer-amounts")
    return _outliers(star, activity)


def customer_velocity_hits(star: Star) -> DataFrame:
    """Pairs led by a flagged row of the customer; the second row need not be flagged."""
    leaders = velocity_leaders(star.fact, F.col("is_flagged") == 1, amounts=False)
    return leaders.groupBy("customer_key").agg(F.sum("pairs").alias("velocity_hit_count"))


def _signals(star: Star) -> DataFrame:
    activity = write_table(customer_activity(star), "customer-activity")
    return activity.join(_outliers(star, activity), "customer_key", "left").join(
        customer_velocity_hits(star), "customer_key", "left"
    ).select(
        "customer_key",
        "total_txns",
        "flagged_count",
        _share(F.col("flagged_count"), F.col("total_txns")).alias("flagged_share"),
        _share(F.col("off_hours_count"), F.col("total_txns")).alias("off_hours_share"),
        "geo_mismatch_count",
        "high_risk_country_count",
        # A join on the customer finds no shell share for rows without one.
        F.when(F.col("customer_key").isNotNull(), _share(F.col("shell_rows"), F.col("merchant_rows"))).alias("shell_share"),
        "outlier_txn_count",
        F.coalesce("velocity_hit_count", F.lit(0)).alias("velocity_hit_count"),
    )


def composite_of(weights: dict[str, int] = WEIGHTS) -> Column:
    return sum((F.col(score) * weight for score, weight in weights.items()), F.lit(0)).cast("bigint")


def tier_of(score: Column) -> Column:
    tier = F
    for name, floor in TIER_FLOORS.items():
        tier = tier.when(score >= floor, name)
    return tier.otherwise(RISK_TIERS[-1])


def score_customers(signals: DataFrame) -> DataFrame:
    """Quintiles, composite score and tier of a stored table of signals."""
    scored = with_quantiles(signals, SCORES, "customer_key")
    return scored.withColumn("composite_risk_score", composite_of()).withColumn(
        "risk_tier", tier_of(F.col("composite_risk_score"))
    )


def customer_risk_scores(star: Star) -> DataFrame:
    """Signals, quintiles, score and tier of every customer, computed once per star."""
    return star.shared(
        "customer-risk-scores",
        lambda: score_customers(write_result(star.spark, lambda: _signals(star), "customer-signals")),
    )


def customer_risk_score_table(star: Star) -> DataFrame:
    return customer_risk_scores(star).select(
        "customer_key",
        *[f"{score}" for score in SCORES.values()],
        "composite_risk_score",
        "risk_tier",
    )


def write_scores(star: Star, target: str, run_date: datetime.date) -> None:
    """Keep all signals, quintiles, scores and tiers below `target`, in a folder of its own for each run date.

    A second run of one date replaces the scores of that date at once, when all
    of its own are written; if it fails before, readers go on finding the earlier ones.
    """
    publish(customer_risk_scores(star), _run_path(target, run_date))


def read_scores(star: Star, target: str, run_date: datetime.date) -> Star:
    """A star whose jobs on scores (q41, q42, s5 to s8, d13, d17, d18, a3, a4) read what was kept for a run date."""
    kept = Star(star.spark, star.table)
    kept.shared("customer-risk-scores", lambda: published(star.spark, _run_path(target, run_date)))
    return kept


def _run_path(target: str, run_date: datetime.date) -> str:
    return f"{target.rstrip('/')}/run_date={run_date.isoformat()}"


def combined_signals(star: Star) -> DataFrame:
    return customer_risk_scores(star).select(
        "customer_key",
        "total_txns",
        "flagged_count",
        _as_percent("flagged_share", "flagged_pct"),
        _as_percent("off_hours_share", "off_hours_pct"),
        "geo_mismatch_count",
        "high_risk_country_count",
        _as_percent("shell_share", "shell_txn_pct"),
        "outlier_txn_count",
        "velocity_hit_count",
    )


def ntile_scores(star: Star) -> DataFrame:
    return customer_risk_scores(star).select("customer_key", *SCORES.values())


def composite_score(star: Star) -> DataFrame:
    return customer_risk_scores(star).select("customer_key", "composite_risk_score")


def risk_tier(star: Star) -> DataFrame:
    return customer_risk_scores(star).select("customer_key", "risk_tier")


def top_risk_customers(star: Star, count: int = 50) -> DataFrame:
    profile = star.customer.select(
        "customer_key", "customer_id", "full_name", "customer_segment", "kyc_status",
        F.col("country").alias("home_country"),
    )
    known = customer_risk_scores(star).join(profile, "customer_key")
    return top(known, count, F.col("composite_risk_score").desc(), F.col("customer_key")).select(
        "customer_id",
        "full_name",
        "customer_segment",
        "kyc_status",
        "home_country",
        _as_percent("flagged_share", "flagged_pct"),
        _as_percent("off_hours_share", "off_hours_pct"),
        F.col("geo_mismatch_count").alias("geo_mismatches"),
        F.col("high_risk_country_count").alias("high_risk_country_txns"),
        _as_percent("shell_share", "shell_merchant_pct"),
        F.col("outlier_txn_count").alias("amount_outliers"),
        F.col("velocity_hit_count").alias("velocity_hits"),
        "composite_risk_score",
        "risk_tier",
    )


def risk_tier_summary(star: Star) -> DataFrame:
    tiers = customer_risk_scores(star).groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customer_count"))
    # Five rows at most reach this window.
    everyone = F.sum("customer_count").over(Window.partitionBy())
    return tiers.withColumn("percentage_of_customers", exact.percent(F.col("customer_count"), everyone)).orderBy(
        place_in(F.col("risk_tier"), RISK_TIERS)
    )
