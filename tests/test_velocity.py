"""Velocity counts and the closest pairs against all pairs built by hand."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from stars import frame_of

from ledgerlens.operators import velocity
from ledgerlens.operators.velocity import closest_pairs, pair_order, velocity_leaders, velocity_pairs
from ledgerlens.plans import anomalies, scoring
from ledgerlens.session import write_table

START = datetime.datetime(2024, 5, 1, 23, 50)
REACH = datetime.timedelta(seconds=660)


def at(seconds: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


def pairs_by_hand(rows, leads):
    for a in rows:
        for b in rows:
            if not leads(a) or None in (a["account_key"], a["transaction_datetime"], b["transaction_datetime"]):
                continue
            gap = b["transaction_datetime"] - a["transaction_datetime"]
            apart = datetime.timedelta(0) < gap < REACH
            if a["account_key"] == b["account_key"] and apart and a["transaction_id"] != b["transaction_id"]:
                yield a, b


def random_rows(rng, count, accounts, span, recurring=False, micros=False, unknown=0.0):
    rows = []
    for key in range(count):
        second = rng.randint(0, span) + (rng.random() if micros else 0)
        rows.append(
            {
                "transaction_key": key,
                "transaction_id": f"T{rng.randint(0, count // 3) if recurring else key}",
                "account_key": rng.choice([*range(accounts), None]) if rng.random() < 0.1 else rng.randint(1, accounts),
                "customer_key": rng.randint(1, 3),
                "transaction_datetime": at(second) if rng.random() > 0.03 else None,
                "amount_usd": f"{rng.randint(1, 30)}.{rng.randint(0, 99):02d}" if rng.random() >= unknown else None,
                "is_flagged": int(rng.random() < 0.5),
            }
        )
    return rows


SHAPES = [
    dict(count=150, accounts=4, span=4000),
    dict(count=150, accounts=4, span=4000, micros=True),
    dict(count=150, accounts=2, span=3000, recurring=True),
    dict(count=150, accounts=3, span=60000, recurring=True),
    dict(count=200, accounts=1, span=5),  # one hot account, a handful of instants
    dict(count=150, accounts=2, span=3000, recurring=True, unknown=0.3),
    dict(count=120, accounts=2, span=2000, micros=True, unknown=0.9),
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_all_pairs(spark, shape, seed):
    rows = random_rows(random.Random(seed), **shape)
    wanted = defaultdict(lambda: [0, 0, 0])
    for a, _ in pairs_by_hand(rows, lambda row: row["is_flagged"] == 1):
        total = wanted[a["account_key"], a["customer_key"]]
        total[0] += 1
        total[1] += int((a["amount_usd"] or "0").replace(".", ""))
        total[2] += a["amount_usd"] is not None
    got = velocity_leaders(frame_of(spark, "fact_transactions", rows), F.col("is_flagged") == 1)
    got = got.groupBy("account_key", "customer_key").agg(F.sum("pairs"), F.sum("pair_cents"), F.sum("paid_pairs"))
    assert {(r[0], r[1]): [r[2], int(r[3] or 0), r[4]] for r in got.collect()} == dict(wanted)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("count", [1, 7, 40])
def test_closest_pairs_equal_all_pairs(spark, shape, count):
    rows = random_rows(random.Random(count), **shape)
    known_accounts, known_customers = {1, 3}, {1, 2}

    def order(pair):
        a, b = pair
        minutes = (b["transaction_datetime"] - a["transaction_datetime"]) // datetime.timedelta(minutes=1)
        known = all(row["amount_usd"] for row in pair)
        cents = sum(int(row["amount_usd"].replace(".", "")) for row in pair) if known else 0
        return minutes, not known, -cents, a["transaction_key"], b["transaction_key"]

    wanted = [
        pair
        for pair in pairs_by_hand(rows, lambda row: True)
        if pair[0]["account_key"] in known_accounts and pair[0]["customer_key"] in known_customers
    ]
    wanted = [order(pair)[3:] for pair in sorted(wanted, key=order)[:count]]

    accounts = spark.createDataFrame([(k,) for k in known_accounts], "account_key long")
    customers = spark.createDataFrame([(k,) for k in known_customers], "customer_key long")
    found = closest_pairs(frame_of(spark, "fact_transactions", rows), accounts, customers, count)
    first = found.join(accounts, "account_key").join(customers, "customer_key").orderBy(*pair_order()).limit(count)
    assert [(r["first_transaction_key"], r["second_transaction_key"]) for r in first.collect()] == wanted


@pytest.mark.parametrize("shape", SHAPES)
def test_all_pairs_once_each(spark, shape):
    rows = random_rows(random.Random(11), **shape)
    wanted = sorted((a["transaction_key"], b["transaction_key"]) for a, b in pairs_by_hand(rows, lambda row: True))
    frame = frame_of(spark, "fact_transactions", rows)
    found = velocity_pairs(frame, frame)
    assert sorted(map(tuple, found.select("first_transaction_key", "second_transaction_key").collect())) == wanted


def test_gap_edges(mini):
    """Gaps of 0 s, 1 s, 10:00, 10:59.999999 and 11:00 from the first row: the middle three count."""
    times = [0, 0, 1, 600, 659.999999, 660]
    star = mini([{"transaction_datetime": at(t), "is_flagged": int(i == 0)} for i, t in enumerate(times)])
    assert [r["velocity_hit_count"] for r in scoring.customer_velocity_hits(star).collect()] == [3]


def test_the_two_definitions_differ(mini):
    """Flagged, then unflagged: the score counts it, the account summary does not."""
    star = mini([{"transaction_datetime": at(0), "is_flagged": 1}, {"transaction_datetime": at(60), "is_flagged": 0}])
    assert [r["velocity_hit_count"] for r in scoring.customer_velocity_hits(star).collect()] == [1]
    assert anomalies.velocity_account_summary(star).count() == 0
    assert anomalies.velocity_pairs_top(star).count() == 0


def test_amounts_repeat_once_per_pair(mini):
    star = mini([{"transaction_datetime": at(t), "is_flagged": 1, "amount_usd": a} for t, a in ((0, 5), (60, 7), (120, 9))])
    row = anomalies.velocity_account_summary(star).first()
    assert (row["velocity_hits"], row["total_value_usd"], row["average_amount_usd"]) == (3, 17.0, 5.67)
    assert row["last_seen"] == at(60)


def _watched_tables(monkeypatch):
    """Rows of the tables that an operator writes on its way, by label."""
    written = {}

    def counted(frame, label):
        table = write_table(frame, label)
        written[label] = table.count()
        return table

    monkeypatch.setattr(velocity, "write_table", counted)
    return written


def test_clean_ids_are_not_shuffled(spark, monkeypatch):
    """Where no id recurs, hardly a row is looked at once more; one that does is found among many."""
    written = _watched_tables(monkeypatch)
    rng = random.Random(21)
    rows = [
        {"transaction_key": i, "transaction_id": f"T{i}", "account_key": rng.randrange(400), "transaction_datetime": at(rng.randrange(80_000)), "is_flagged": 1}
        for i in range(4000)
    ]
    leaders = velocity_leaders(frame_of(spark, "fact_transactions", rows), F.col("is_flagged") == 1)
    pairs = leaders.agg(F.sum("pairs")).first()[0]
    assert pairs > 100 and written["suspect-cells"] < 40 and written.get("suspect-rows", 0) < 0.02 * len(rows)
    again = dict(rows[7], transaction_key=4000, transaction_datetime=rows[7]["transaction_datetime"] + datetime.timedelta(seconds=30))
    leaders = velocity_leaders(frame_of(spark, "fact_transactions", [*rows, again]), F.col("is_flagged") == 1)
    more = leaders.agg(F.sum("pairs")).first()[0] - pairs
    others = [r for r in rows if r["account_key"] == again["account_key"] and r is not rows[7]]
    assert more == sum(datetime.timedelta(0) < abs(r["transaction_datetime"] - again["transaction_datetime"]) < REACH for r in others)


def test_few_rows_are_looked_at_for_the_closest_pairs(spark, monkeypatch):
    """A bound from pairs that are known to exist leaves a fixed number of leaders, whatever the number of pairs."""
    rng = random.Random(22)
    for count in (2000, 8000):
        written = _watched_tables(monkeypatch)
        rows = [
            {"transaction_key": i, "transaction_id": f"T{i}", "account_key": rng.randrange(20), "transaction_datetime": at(rng.randrange(50_000)), "amount_usd": f"{rng.randrange(1, 10**6)}.00"}
            for i in range(count)
        ]
        frame = frame_of(spark, "fact_transactions", rows)
        accounts = spark.createDataFrame([(k,) for k in range(20)], "account_key long")
        customers = spark.createDataFrame([(1,)], "customer_key long")
        kept = []
        result = velocity.write_result
        monkeypatch.setattr(velocity, "write_result", lambda *a, result=result: kept.append(result(*a)) or kept[-1])
        pairs = closest_pairs(frame, accounts, customers, 10)
        assert len(pairs.orderBy(*pair_order()).limit(10).collect()) == 10
        assert written["next-instants"] > 500 and kept[0].count() <= 200


def test_equal_amounts_are_told_apart_by_key(spark):
    """Where all sums are equal, the bound goes by the first row's key."""
    rows = [
        {"transaction_key": 1000 - i, "transaction_id": f"T{i}", "account_key": i % 7, "transaction_datetime": at((i // 7) * 20), "amount_usd": "5.00"}
        for i in range(700)
    ]
    accounts = spark.createDataFrame([(k,) for k in range(7)], "account_key long")
    customers = spark.createDataFrame([(1,)], "customer_key long")
    found = closest_pairs(frame_of(spark, "fact_transactions", rows), accounts, customers, 9).orderBy(*pair_order()).limit(9)
    wanted = sorted((a["transaction_key"], b["transaction_key"]) for a, b in pairs_by_hand(rows, lambda row: True)
                    if b["transaction_datetime"] - a["transaction_datetime"] < datetime.timedelta(seconds=60))[:9]
    assert [(r["first_transaction_key"], r["second_transaction_key"]) for r in found.collect()] == wanted
