"""Scores that outlive the session object, years told apart, and plans that move narrow rows."""

from __future__ import annotations

import datetime
import re

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from ledgerlens.jobs import JOBS
from ledgerlens.plans import customers, scoring
from ledgerlens.sources.order_star import order_star
from ledgerlens.sources.published import publish, published
from ledgerlens.sources.star import Star

READERS = ["q41_top_risk_customers", "q42_risk_tier_summary", "d13_tier_kpis", "d17_tier_distribution", "d18_watchlist_top10"]


def test_jobs_read_the_scores_of_a_run_date(spark, mini, tmp_path):
    star = mini([{"customer_key": 1, "is_flagged": 1}, {"customer_key": 1}])
    first, second = datetime.date(2024, 5, 1), datetime.date(2024, 5, 2)
    scoring.write_scores(star, str(tmp_path), first)
    scoring.write_scores(mini([{"customer_key": 1}] * 3 + [{"customer_key": 2}]), str(tmp_path), second)
    kept = scoring.read_scores(Star(spark, star.table), str(tmp_path), first)
    for name in READERS:
        assert JOBS[name](kept).collect() == JOBS[name](star).collect()
    later = scoring.read_scores(star, str(tmp_path), second)
    assert sorted(r["customer_key"] for r in scoring.composite_score(later).collect()) == [1, 2]
    scoring.write_scores(star, str(tmp_path), second)
    assert scoring.composite_score(scoring.read_scores(star, str(tmp_path), second)).count() == 1


def test_a_failing_run_leaves_the_earlier_scores(spark, mini, tmp_path):
    star, day = mini([{"customer_key": 1, "is_flagged": 1}]), datetime.date(2024, 5, 1)
    scoring.write_scores(star, str(tmp_path), day)
    broken = Star(spark, star.table)
    kept = scoring.customer_risk_scores(star)
    broken.shared("customer-risk-scores", lambda: kept.withColumn("customer_key", F.raise_error(F.lit("lost")).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        scoring.write_scores(broken, str(tmp_path), day)
    read = scoring.read_scores(star, str(tmp_path), day)
    assert [tuple(r) for r in scoring.composite_score(read).collect()] == [tuple(r) for r in scoring.composite_score(star).collect()]


def test_versions_are_switched_and_dropped(spark, tmp_path):
    target = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        published(spark, target)
    publish(spark.range(1), target)
    first = published(spark, target)
    publish(spark.range(2), target)
    assert (first.count(), published(spark, target).count()) == (1, 2)  # who has begun with a version can end with it
    (tmp_path / "table" / "version-failed").mkdir()
    publish(spark.range(3), target)
    assert published(spark, target).count() == 3
    assert len([path for path in (tmp_path / "table").iterdir() if path.name.startswith("version-")]) == 2


def test_years_are_told_apart_on_request(mini):
    dates = [
        {"date_key": 20230000 + i, "year_number": 2023 + i % 2, "month_number": m, "month_name": str(m), "quarter_number": (m + 2) // 3}
        for i, m in enumerate([1, 1, 7, 7])
    ]
    # 2023: 10 in January, 50 in July; 2024: 100 in January, 50 in July.
    facts = [{"date_key": d["date_key"], "amount_usd": a} for d, a in zip(dates, ("10", "100", "50", "50"), strict=True)]
    star = mini(facts, dim_date=dates)
    apart = customers.quarter_spend_spike(star, with_year=True).collect()
    assert [(r["year_number"], r["monthly_spend"], r["q1_q2_baseline_spend"]) for r in apart] == [(2023, 50.0, 10.0)]
    assert customers.quarter_spend_spike(star).collect() == []


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def _exchanged(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^,)]*)", plan)


def test_the_fact_is_not_sorted_for_pauses(spark, small_folder):
    plan = plan_of(JOBS["q28_dormant_reactivation"](order_star(spark, small_folder)))
    assert "SortAggregate" not in plan.split("BroadcastExchange")[-1]


@pytest.mark.parametrize("name", ["q10_country_breakdown", "q14_account_type_breakdown", "q24_customer_baseline",
                                  "q31_merchant_overview", "q33_shell_merchants", "q34_merchant_category_summary"])
def test_distinct_counts_shuffle_numbers(spark, small_folder, no_broadcast, name):
    """The texts of a dimension are in no exchange that also holds the fact's customers or accounts."""
    plan = plan_of(JOBS[name](order_star(spark, small_folder)))
    for grain in re.findall(r"keys=\[([^\]]*)\], functions=\[(?:partial_|merge_)", plan):
        keys = {key.split("#")[0].strip() for key in grain.split(",")}
        if keys & {"customer_key", "account_key"}:
            assert not keys & {"country", "region", "account_type", "full_name", "merchant_name", "merchant_category", "merchant_country"}
