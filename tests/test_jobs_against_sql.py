"""Every job against the independent SQL statement, on the smallest data set, and what no plan may contain."""

from __future__ import annotations

import __spark_entry__ as contract
import compare
import pytest
from ledgerlens.jobs import JOBS
from oracle import ORACLE


@pytest.fixture(scope="module")
def connection(small_folder):
    return compare.connect(small_folder)


def test_every_job_has_an_oracle():
    assert set(JOBS) == set(ORACLE)
    assert set(JOBS) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


# Global windows are allowed over rows of a small, bounded grain only.
OVER_FEW_ROWS = {
    "q13_high_risk_country_share",  # two rows
    "q21_daily_spikes",  # calendar days
    "q42_risk_tier_summary",  # five rows
    "d05_segment_value_share",  # segments
    "d19_quarter_change",  # quarters
}


# A top of pairs under a rule on their ids has no linear form in built-in operators.
WITH_PYTHON = {"q18_velocity_pairs"}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job_equals_sql(spark, small_folder, connection, name):
    job = contract.queries()[name](spark, small_folder)
    plan = compare.plan_of(job)
    assert "CartesianProduct" not in plan
    assert any(node in plan for node in ("Python", "Pandas", "InArrow")) == (name in WITH_PYTHON)
    assert (compare.global_windows(plan) > 0) == (name in OVER_FEW_ROWS)
    assert compare.differences(job, connection, contract.oracle_sql()[name]) == []


def test_a_wrong_statement_is_noticed(spark, small_folder, connection):
    job = contract.queries()["q05_status_breakdown"](spark, small_folder)
    wrong = contract.oracle_sql()["q05_status_breakdown"].replace("'Failed'", "'Fail'")
    assert compare.differences(job, connection, wrong)
