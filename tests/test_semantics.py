"""Small hand-made stars for the rules that are easy to get wrong."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.labels import RISK_TIERS, WEEKDAYS, place_in
from ledgerlens.plans import anomalies, audits, baseline, customers, dashboard, merchants, scoring


def day(text: str) -> str:
    return f"{text}T12:00:00"


def rows_of(frame, *names):
    return [tuple(row[n] for n in names) for row in frame.collect()]


def test_shares_are_missing_when_nothing_is_flagged(mini):
    star = mini([{}, {}])
    shares = merchants.merchant_concentration(star)
    assert rows_of(shares, "percentage_of_all_fraud", "cumulative_fraud_percentage") == [(None, None)]


def test_zero_mean_gives_no_multiple(mini):
    star = mini([{"amount_usd": 0}])
    assert rows_of(anomalies.amount_outliers(star), "times_above_average") == [(None,)]


def test_country_share_without_value(mini):
    star = mini([{"amount_usd": 0}])
    assert rows_of(baseline.high_risk_country_share(star), "percentage_of_total_value") == [(None,)]


def test_one_transaction_is_its_own_outlier(mini):
    star = mini([{"amount_usd": "19.99"}])
    assert rows_of(scoring.amount_signal(star), "outlier_txn_count") == [(1,)]


def test_equal_amounts_are_all_outliers(mini):
    star = mini([{"amount_usd": "0.10"}] * 3)
    assert rows_of(scoring.amount_signal(star), "outlier_txn_count") == [(3,)]
    assert rows_of(scoring.customer_amount_stats(star), "avg_amount", "stddev_amount") == [(0.1, 0.0)]


def test_customer_without_known_place_gets_no_signal_and_the_lowest_quintile(mini):
    facts = [{"customer_key": k, "location_key": 9 if k == 5 else 1, "merchant_key": 9 if k == 5 else 1} for k in range(1, 6)]
    people = [{"customer_key": k, "customer_id": f"C{k}", "full_name": f"N{k}", "country": "B"} for k in range(1, 6)]
    star = mini(facts, dim_customer=people)
    signals = {r["customer_key"]: r for r in scoring.combined_signals(star).collect()}
    assert signals[5]["geo_mismatch_count"] is None and signals[5]["shell_txn_pct"] is None
    assert signals[1]["geo_mismatch_count"] == 1
    scores = {r["customer_key"]: r for r in scoring.ntile_scores(star).collect()}
    assert scores[5]["geo_score"] == 1 and scores[5]["shell_score"] == 1
    assert [scores[k]["geo_score"] for k in (1, 2, 3, 4)] == [2, 3, 4, 5]
    assert {r["customer_key"] for r in scoring.geo_signal(star).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize(
    "score, tier",
    [(19, "MINIMAL"), (20, "LOW"), (39, "LOW"), (40, "MEDIUM"), (59, "MEDIUM"), (60, "HIGH"), (79, "HIGH"),
     (80, "CRITICAL"), (100, "CRITICAL")],
)
def test_tier_edges(spark, score, tier):
    assert spark.range(1).select(scoring.tier_of(F.lit(score))).first()[0] == tier


@pytest.mark.parametrize("bucket, score", [(1, 20), (5, 100)])
def test_score_range(spark, bucket, score):
    frame = spark.range(1).select(*[F.lit(bucket).alias(name) for name in scoring.WEIGHTS])
    assert frame.select(scoring.composite_of()).first()[0] == score


def test_running_share_is_common_to_ties(mini):
    flagged = {1: 5, 2: 3, 3: 3, 4: 1}
    facts = [{"merchant_key": m, "is_flagged": 1} for m, n in flagged.items() for _ in range(n)]
    shops = [{"merchant_key": m, "merchant_name": f"M{m}"} for m in flagged]
    star = mini(facts, dim_merchant=shops)
    got = rows_of(merchants.merchant_concentration(star), "merchant_name", "cumulative_fraud_percentage")
    assert got == [("M1", 41.67), ("M2", 91.67), ("M3", 91.67), ("M4", 100.0)]


def test_share_is_rounded_before_the_threshold(mini):
    """20.004 % becomes 20.00 and does not pass `above 20`; 20.01 % does."""
    facts = [{"customer_key": 1, "is_flagged": int(i < 5001)} for i in range(24999)]
    assert customers.high_risk_customers(mini(facts)).count() == 0
    facts = [{"customer_key": 1, "is_flagged": int(i < 2002)} for i in range(10000)]
    assert rows_of(customers.high_risk_customers(mini(facts)), "flagged_percentage") == [(20.02,)]


def test_missing_values_never_mismatch(mini):
    people = [
        {"customer_key": 1, "customer_id": "C1", "full_name": "N1", "country": None, "preferred_channel": None},
        {"customer_key": 2, "customer_id": "C2", "full_name": "N2", "country": "B", "preferred_channel": "ATM"},
    ]
    star = mini([{"customer_key": 1}, {"customer_key": 2}], dim_customer=people)
    assert rows_of(anomalies.geo_mismatch_transactions(star), "customer_id") == [("C2",)]
    assert rows_of(customers.unusual_channel_use(star), "customer_id") == [("C2",)]
    assert rows_of(customers.customer_watchlist(star), "customer_id", "geo_mismatch_count") == [("C2", 1), ("C1", 0)]


def test_merchants_with_equal_descriptions_merge(mini):
    shops = [{"merchant_key": k, "merchant_name": "Same"} for k in (1, 2)]
    facts = [{"merchant_key": 1, "customer_key": 1}, {"merchant_key": 2, "customer_key": 1}, {"merchant_key": 2}]
    star = mini(facts, dim_merchant=shops)
    assert rows_of(merchants.merchant_overview(star), "merchant_name", "total_transactions", "unique_customers") == [
        ("Same", 3, 1)
    ]
    assert rows_of(merchants.merchant_category_summary(star), "merchant_count", "unique_customers") == [(1, 1)]


def test_customers_with_equal_descriptions_merge(mini):
    people = [{"customer_key": k, "customer_id": "C", "full_name": "N"} for k in (1, 2)]
    facts = [{"customer_key": 1, "account_key": 7}, {"customer_key": 2, "account_key": 7}, {"customer_key": 2}]
    got = customers.customer_baseline(mini(facts, dim_customer=people))
    assert rows_of(got, "total_transactions", "accounts_used") == [(3, 2)]


def test_orphans_are_counted_and_left_out(mini):
    keys = ("customer_key", "account_key", "merchant_key", "location_key", "date_key")
    facts = [{}, {k: None for k in keys}, {k: 99 for k in keys}]
    star = mini(facts)
    assert rows_of(baseline.overall_summary(star), "total_transactions") == [(3,)]
    assert rows_of(baseline.segment_breakdown(star), "total_transactions") == [(1,)]
    assert rows_of(baseline.country_breakdown(star), "total_transactions") == [(1,)]
    assert rows_of(baseline.monthly_trend(star), "total_transactions") == [(1,)]
    assert rows_of(merchants.merchant_overview(star), "total_transactions") == [(1,)]
    assert rows_of(baseline.account_type_breakdown(star), "total_transactions") == [(1,)]
    audit = audits.orphan_audit(star)
    assert rows_of(audit, "missing_key_rows", "unknown_key_rows") == [(1, 1)] * 5


def test_one_row_of_a_return_date_carries_the_gap(mini):
    facts = [
        {"transaction_datetime": day("2024-01-01")},
        {"transaction_datetime": "2024-03-01T18:00:00", "amount_usd": 3},
        {"transaction_datetime": "2024-03-01T09:00:00", "amount_usd": 1},
        {"transaction_datetime": "2024-03-01T09:30:00", "amount_usd": 2},
        {"transaction_datetime": day("2024-04-29")},
    ]
    got = customers.dormant_reactivation(mini(facts))
    assert rows_of(got, "days_dormant", "return_transaction_amount") == [(60, 1.0)]
    assert rows_of(dashboard.dormant_customer_total(mini(facts)), "dormant_reactivations") == [(1,)]
    assert rows_of(dashboard.dormant_customer_total(mini(facts[1:])), "dormant_reactivations") == [(0,)]


def test_weekday_outside_the_list_comes_first(spark):
    frame = spark.createDataFrame([("Sunday",), ("Someday",), (None,), ("Monday",)], "d string")
    got = frame.select("d", place_in(F.col("d"), WEEKDAYS).alias("p")).collect()
    assert {r["d"]: r["p"] for r in got} == {"Sunday": 7, "Someday": 0, None: 0, "Monday": 1}


def test_spend_spike_needs_a_first_half_and_skips_idle_months(mini):
    facts = [
        {"transaction_datetime": day("2024-01-05"), "amount_usd": 100},
        {"transaction_datetime": day("2024-05-05"), "amount_usd": 50},
        {"transaction_datetime": day("2024-07-05"), "amount_usd": 150},
        {"transaction_datetime": day("2024-08-05"), "amount_usd": "150.01"},
        {"transaction_datetime": day("2024-08-06"), "amount_usd": 900, "customer_key": 2},
    ]
    people = [{"customer_key": k, "customer_id": f"C{k}", "full_name": f"N{k}"} for k in (1, 2)]
    got = customers.quarter_spend_spike(mini(facts, dim_customer=people))
    assert rows_of(got, "customer_id", "month_name", "q1_q2_baseline_spend", "spend_multiplier") == [
        ("C1", "August", 75.0, 2.0)
    ]


def test_months_join_across_years_unless_asked(mini):
    days = [
        {"date_key": int(f"{y}0105"), "full_date": datetime.date(y, 1, 5), "year_number": y, "month_number": 1,
         "month_name": "January", "quarter_number": 1}
        for y in (2023, 2024)
    ]
    star = mini([{"transaction_datetime": day(f"{y}-01-05")} for y in (2023, 2024)], dim_date=days)
    assert merchants.channel_monthly_trend(star).count() == 1
    assert merchants.channel_monthly_trend(star, with_year=True).count() == 2
    assert baseline.monthly_trend(star).count() == 2


def test_hours_and_tiers_are_complete(mini):
    star = mini([{"is_flagged": 1}, {}])
    hours = dashboard.hour_flag_histogram(star).collect()
    assert [r["transaction_hour"] for r in hours] == list(range(24))
    assert (hours[12]["flagged_count"], hours[12]["unflagged_count"]) == (1, 1)
    assert sum(r["flagged_count"] + r["unflagged_count"] for r in hours) == 2
    tiers = dashboard.tier_distribution(star).collect()
    assert [r["risk_tier"] for r in tiers] == RISK_TIERS
    assert sum(r["customer_count"] for r in tiers) == 1


@pytest.mark.parametrize("flagged, band", [(0, "green"), (5, "green"), (6, "amber"), (10, "amber"), (11, "red")])
def test_bands_compare_the_rounded_share(mini, flagged, band):
    star = mini([{"is_flagged": int(i < flagged)} for i in range(100)])
    assert rows_of(dashboard.monthly_kpi_banded(star), "flagged_percentage", "band") == [(float(flagged), band)]


def test_cards_filter_by_quarter_and_channel(mini):
    facts = [
        {"transaction_datetime": day("2024-02-01"), "channel": "Web", "amount_usd": 5, "is_flagged": 1},
        {"transaction_datetime": day("2024-08-01"), "channel": "Web", "amount_usd": 7},
        {"transaction_datetime": day("2024-08-01"), "channel": "ATM", "amount_usd": 9, "is_flagged": 1},
    ]
    star = mini(facts)
    names = ("total_transactions", "total_value_usd", "flagged_percentage", "suspicious_value_usd")
    assert rows_of(dashboard.kpi_cards(star), *names) == [(3, 21.0, 66.67, 14.0)]
    assert rows_of(dashboard.kpi_cards(star, quarter=3), *names) == [(2, 16.0, 50.0, 9.0)]
    assert rows_of(dashboard.kpi_cards(star, 3, "Web"), *names) == [(1, 7.0, 0.0, None)]


def test_quarter_change_of_either_sign(mini):
    counts = {"2024-01-10": 2, "2024-04-10": 3, "2024-07-10": 1}
    facts = [{"transaction_datetime": day(d), "is_flagged": 1} for d, n in counts.items() for _ in range(n)]
    got = dashboard.quarter_change(mini(facts))
    assert rows_of(got, "quarter_number", "change_percentage") == [(1, None), (2, 50.0), (3, -66.67)]


def test_figures_that_disagree_are_shown(mini):
    star = mini([{}, {"date_key": 20300101}, {"channel": None}])
    checks = {r["check_name"]: r for r in audits.reference_number_check(star, {"transactions": 4}).collect()}
    assert (checks["transactions by month"]["difference"], checks["transactions by month"]["agrees"]) == (-1, 0)
    assert checks["transactions by channel"]["found"] == 2
    assert checks["transactions by type"]["agrees"] == 1
    assert checks["customers by risk tier"]["agrees"] == 1
    assert checks["expected transactions"]["difference"] == -1


def test_months_and_channels_add_up_to_the_total(spark, small_folder):
    from ledgerlens.sources.order_star import order_star

    star = order_star(spark, small_folder)
    total = baseline.overall_summary(star).first()
    for job in (baseline.monthly_trend, baseline.channel_breakdown, baseline.hourly_distribution):
        sums = job(star).agg(F.sum("total_transactions"), F.sum("flagged_count")).first()
        assert tuple(sums) == (total["total_transactions"], total["flagged_count"])
    scores = scoring.composite_score(star).agg(F.min("composite_risk_score"), F.max("composite_risk_score")).first()
    assert scores[0] >= 20 and scores[1] <= 100
    sizes = [r["count"] for r in scoring.ntile_scores(star).groupBy("velocity_score").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_outliers_without_a_key_and_outliers_twice(mini):
    """Rows that are equal in all that ranks them are each listed once, also without a transaction key."""
    far = [{"amount_usd": "900.00", "transaction_key": None, "transaction_id": "a"}, {"amount_usd": "900.00", "transaction_key": None, "transaction_id": "b"}]
    twice = [{"amount_usd": "900.00", "transaction_key": 7, "transaction_id": "c"}] * 2
    star = mini([{"amount_usd": "1.00"}] * 60 + far + twice)
    assert [r["transaction_id"] for r in anomalies.amount_outliers(star, 50).collect()][2:] == ["c", "c"]
    assert {r["transaction_id"] for r in anomalies.amount_outliers(star, 50).collect()} == {"a", "b", "c"}
    assert len(anomalies.amount_outliers(star, 3).collect()) == 3
