"""Every job against its SQL on a star with missing keys, flags, amounts and labels, and ids that recur."""

from __future__ import annotations

import datetime
import random

import compare
import duckdb
import pytest
from stars import DEFAULTS, date_row, frame_of

from ledgerlens.jobs import JOBS
from ledgerlens.plans import anomalies, merchants, scoring
from ledgerlens.sources.star import Star
from oracle import ORACLE, STAR

START = datetime.datetime(2024, 1, 1)


def _facts(draw, count):
    def some(value, share=0.06):
        return None if draw.random() < share else value

    for key in range(count):
        moment = START + datetime.timedelta(days=draw.choice([1, 40, 41, 120, 200, 230]), seconds=draw.randrange(5000))
        yield {
            "transaction_key": key,
            "transaction_id": f"T{draw.randrange(count // 2)}",
            "customer_key": some(draw.randrange(1, 12)),
            "account_key": some(draw.randrange(1, 6)),
            "merchant_key": some(draw.randrange(1, 9)),
            "location_key": some(draw.randrange(1, 7)),
            "transaction_datetime": moment,
            "amount_usd": some(f"{draw.choice([1, 5, 5, 20, 900])}.{draw.randrange(100):02d}", 0.15),
            "is_flagged": some(int(draw.random() < 0.4)),
            "is_off_hours": some(int(moment.hour in (1, 2))),
            "channel": some(draw.choice(["Web", "Mobile", "ATM"])),
            "transaction_type": some(draw.choice(["Purchase", "Transfer"])),
            "status": some("Completed"),
        }


def _dimensions(draw):
    countries = ["A", "B", None]
    yield "dim_customer", [
        {"customer_key": k, "customer_id": f"C{k}", "full_name": f"N{k % 7}", "country": draw.choice(countries),
         "kyc_status": draw.choice(["Verified", "Expired", None]), "customer_segment": draw.choice(["Retail", "SME", None]),
         "preferred_channel": draw.choice(["Web", "ATM", None])} for k in range(1, 10)
    ]
    yield "dim_account", [{"account_key": k, "account_id": f"A{k}", "account_type": draw.choice(["Savings", None])} for k in range(1, 5)]
    yield "dim_merchant", [
        {"merchant_key": k, "merchant_name": f"M{k % 5}", "risk_rating": draw.choice(["Low", "High", None]),
         "merchant_category": draw.choice(["Retail", "Crypto", None]), "is_shell_merchant": draw.choice([0, 1]),
         "country": draw.choice(countries)} for k in range(1, 8)
    ]
    yield "dim_location", [
        {"location_key": k, "country": draw.choice(countries), "city": f"X{k}", "is_high_risk_country": k % 2} for k in range(1, 6)
    ]


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    draw, folder = random.Random(8), tmp_path_factory.mktemp("dirty")
    tables = {"fact_transactions": list(_facts(draw, 700)), **dict(_dimensions(draw))}
    tables["dim_date"] = [date_row((START + datetime.timedelta(days=i)).date()) for i in range(274)]
    assert set(tables) == set(DEFAULTS)
    connection = duckdb.connect()
    for name, rows in tables.items():
        frame_of(spark, name, rows).coalesce(1).write.parquet(f"{folder}/{name}")
        cents = ", CAST(amount_usd * 100 AS BIGINT) AS cents" if name == "fact_transactions" else ""
        connection.execute(f"CREATE TABLE {name} AS SELECT *{cents} FROM read_parquet('{folder}/{name}/*.parquet')")
    return Star.from_parquet(spark, str(folder)), connection


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job_equals_sql(dirty, name):
    star, connection = dirty
    sql = ORACLE[name].replace(STAR.strip(), "nothing AS (SELECT 1)")
    assert compare.differences(JOBS[name](star), connection, sql) == []


def test_rows_without_a_customer_have_no_shell_share(mini):
    """The group without a customer ranks first, so it must not move the quintiles of customers."""
    merchants_ = [{"merchant_key": k, "is_shell_merchant": k - 1} for k in (1, 2)]
    facts = [{"customer_key": c, "merchant_key": m} for c in (1, 2, 3, 4) for m in [2] * c + [1] * (5 - c)]
    facts += [{"customer_key": None, "merchant_key": 2}] * 5
    star = mini(facts, dim_merchant=merchants_)
    assert {r["customer_key"]: r["shell_txn_pct"] for r in scoring.combined_signals(star).collect()} == {
        None: None, 1: 20.0, 2: 40.0, 3: 60.0, 4: 80.0
    }
    assert {r["customer_key"]: r["shell_score"] for r in scoring.ntile_scores(star).collect()} == {None: 1, 1: 2, 2: 3, 3: 4, 4: 5}
    assert {r["customer_key"] for r in scoring.shell_signal(star).collect()} == {None, 1, 2, 3, 4}


def test_the_average_of_an_account_skips_unknown_amounts(mini):
    times = [START + datetime.timedelta(seconds=60 * i) for i in range(4)]
    facts = [
        {"transaction_datetime": t, "amount_usd": a, "is_flagged": 1} for t, a in zip(times, (None, None, 10, 99), strict=True)
    ]
    row = anomalies.velocity_account_summary(mini(facts)).first()
    assert (row["velocity_hits"], row["total_value_usd"], row["average_amount_usd"]) == (6, 10.0, 10.0)


def test_the_first_pair_does_not_depend_on_the_number_asked_for(mini):
    facts = [
        {"transaction_datetime": START + datetime.timedelta(seconds=s), "amount_usd": a, "is_flagged": 1}
        for s, a in ((0, 50), (0, 100), (5, None))
    ]
    star = mini(facts)
    first = [anomalies.velocity_pairs_top(star, n).first()["first_txn"] for n in (1, 2, 50)]
    assert len(set(first)) == 1 and first[0] == "T1"


def test_a_merchant_whose_flags_are_missing_is_listed_last(mini):
    merchants_ = [{"merchant_key": k, "merchant_name": f"M{k}"} for k in (1, 2)]
    star = mini([{"merchant_key": 1, "is_flagged": 1}, {"merchant_key": 2, "is_flagged": None}], dim_merchant=merchants_)
    rows = merchants.merchant_concentration(star).collect()
    assert [(r["merchant_name"], r["cumulative_fraud_percentage"]) for r in rows] == [("M1", 100.0), ("M2", 100.0)]
