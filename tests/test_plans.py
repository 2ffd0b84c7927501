"""What reaches the scan, and what is not sorted. See also the plan checks in test_jobs_against_sql."""

from __future__ import annotations

import re

import __spark_entry__ as contract
import pytest
from compare import plan_of

from ledgerlens.operators import velocity
from ledgerlens.session import write_table


@pytest.mark.parametrize(
    "name, columns",
    [
        ("q03_channel_breakdown", {"amount_usd", "is_flagged", "channel"}),
        ("q02_monthly_trend", {"date_key", "amount_usd", "is_flagged"}),
        ("s2_geo_signal", {"customer_key", "location_key"}),
        ("d15_dormant_customer_total", {"customer_key", "transaction_date"}),
        ("q40_customer_velocity_hits", {"customer_key", "account_key", "is_flagged", "transaction_datetime", "transaction_id"}),
    ],
)
def test_only_needed_columns_are_read(spark, small_folder, monkeypatch, name, columns):
    """In the plan of the result, and in those of the tables that are written on the way."""
    plans = []

    def watched(frame, label):
        plans.append(plan_of(frame))
        return write_table(frame, label)

    monkeypatch.setattr(velocity, "write_table", watched)
    plans.append(plan_of(contract.queries()[name](spark, small_folder)))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*fact_transactions", "\n".join(plans))
    assert scans
    for scan in scans:
        assert {c.split("#")[0] for c in scan.split(",")} <= columns


@pytest.mark.parametrize("name", ["q15_off_hours_by_hour", "q17_off_hours_by_channel"])
def test_filters_reach_the_scan(spark, small_folder, name):
    plan = plan_of(contract.queries()[name](spark, small_folder))
    assert "EqualTo(is_off_hours,1)" in plan


def test_top_rows_are_not_sorted_globally(spark, small_folder):
    for name in ("q11_city_hotspots", "q22_geo_mismatch_transactions", "q24_customer_baseline", "q41_top_risk_customers"):
        assert "TakeOrderedAndProject" in plan_of(contract.queries()[name](spark, small_folder))


def test_the_audit_reads_the_fact_once(spark, small_folder):
    plan = plan_of(contract.queries()["a2_orphan_audit"](spark, small_folder))
    assert len(re.findall(r"FileScan parquet [^\n]*fact_transactions", plan)) == 1


def test_outliers_are_chosen_on_narrow_rows(spark, small_folder):
    plan = plan_of(contract.queries()["q20_amount_outliers"](spark, small_folder))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*fact_transactions", plan)
    assert {"customer_key", "transaction_key", "amount_usd"} in [{c.split("#")[0] for c in scan.split(",")} for scan in scans]
    assert "TakeOrderedAndProject" in plan
