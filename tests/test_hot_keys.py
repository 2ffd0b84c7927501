"""Hot keys: results stay whole, and no task is left with all rows of a key."""

from __future__ import annotations

import datetime
import random

import pytest
from compare import plan_of
from pyspark.sql import functions as F
from stars import frame_of

from ledgerlens.operators.hot_keys import broadcast_bytes, join_per_key
from ledgerlens.plans import anomalies, baseline, customers, merchants, scoring
from ledgerlens.session import write_table
from ledgerlens.sources.star import Star


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_join_per_key_keeps_every_row(spark, limit):
    rng = random.Random(1)
    keys = [1 if rng.random() < 0.4 else rng.randint(2, 5000) for _ in range(6000)] + [None, -1]
    rows = spark.createDataFrame(list(enumerate(keys)), "n long, k long")
    table = write_table(rows.filter("k > 0").groupBy("k").agg(F.count(F.lit(1)).alias("w")), "test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        joined = join_per_key(rows, table, "k", "w", ["n"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.columns == ["k", "n", "w"]
    assert sorted(map(tuple, joined.collect())) == sorted(
        (k, n, keys.count(k)) for n, k in enumerate(keys) if k is not None and k > 0
    )


@pytest.mark.parametrize(("text", "size"), [("10485760b", 10 << 20), ("256k", 256 << 10), ("-1", -1), ("1GB", 1 << 30), ("5", 5)])
def test_the_sessions_broadcast_limit(spark, text, size):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
    try:
        assert broadcast_bytes(spark) == size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_per_key_divides_the_hot_key(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = write_table(rows.groupBy("k").agg(F.count(F.lit(1)).alias("w")), "test")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = join_per_key(rows, table, "k", "w", ["id"])
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r["count"] for r in sizes) == 30000
    assert max(r["count"] for r in sizes) < 2 * 30000 / 16


def test_join_per_key_never_broadcasts_many_rows_of_small_files(spark):
    """No key is hot, so that the list of hot ones is empty, and the files are far below the limit."""
    table = write_table(spark.range(40000).select(F.col("id").alias("k"), F.lit(5).cast("long").alias("w")), "test")
    rows = spark.range(200000).select((F.col("id") % 40000).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        joined = join_per_key(rows, table, "k", "w", ["id"])
        assert len(joined.collect()) == 200000
        plan = plan_of(joined).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


def test_customers_and_merchants_are_broadcast_by_their_rows(spark, mini, tmp_path):
    """Files of many like rows are below the limit for broadcasts, what the driver would hold of them is not."""
    facts = [{"customer_key": 1, "location_key": 1}, {"customer_key": 1, "location_key": 2}, {"customer_key": None}, {"customer_key": -1}]
    star = mini(facts, dim_location=[{"location_key": 1, "country": "A"}, {"location_key": 2, "country": "B"}])
    tables = {}
    for name, key in (("dim_customer", "customer_key"), ("dim_merchant", "merchant_key")):
        schema, path = star.table(name).schema, str(tmp_path / name)
        alike = {key: F.col("id"), "country": F.lit("A"), "is_shell_merchant": F.lit(1)}
        row = [alike.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        spark.range(800_000).select(*row).coalesce(1).write.parquet(path)
        tables[name] = spark.read.schema(schema).parquet(path)
    activity = scoring.customer_activity(Star(spark, lambda name: tables.get(name) or star.table(name)))
    assert "BroadcastExchange" not in plan_of(activity)
    got = activity.select("customer_key", "total_txns", "shell_rows", "geo_mismatch_count").collect()
    assert sorted(map(tuple, got), key=str) == [(-1, 1, 1, None), (1, 2, 2, 1), (None, 1, 1, None)]


@pytest.fixture(scope="module")
def hot_star(spark):
    """A third of the rows on one customer, account, merchant and location, many of them at one instant."""
    rng = random.Random(4)
    start = datetime.datetime(2024, 3, 1)
    facts = []
    for number in range(6000):
        hot = number % 3 == 0
        key = 1 if hot else rng.randint(2, 400)
        second = rng.choice([0, 60, 700]) if hot and rng.random() < 0.8 else rng.randint(0, 200 * 86400)
        facts.append(
            {
                "customer_key": key,
                "account_key": key,
                "merchant_key": 1 if hot else rng.randint(2, 30),
                "location_key": 1 if hot else rng.randint(2, 20),
                "transaction_datetime": start + datetime.timedelta(seconds=second),
                "amount_usd": f"{rng.randint(1, 900)}.{rng.randint(0, 99):02d}",
                "is_flagged": int(rng.random() < 0.3),
            }
        )
    tables = {
        "fact_transactions": facts,
        "dim_customer": [
            {"customer_key": k, "customer_id": f"C{k}", "full_name": f"N{k}", "country": "AB"[k % 2]}
            for k in range(1, 401)
        ],
        "dim_account": [{"account_key": k, "account_id": f"A{k}"} for k in range(1, 401)],
        "dim_merchant": [{"merchant_key": k, "merchant_name": f"M{k}"} for k in range(1, 31)],
        "dim_location": [{"location_key": k, "country": "ABC"[k % 3], "city": f"L{k}"} for k in range(1, 21)],
        "dim_date": [{"date_key": 20240301 + d, "month_number": 3, "quarter_number": 1} for d in range(30)],
    }
    stored = {name: write_table(frame_of(spark, name, rows), name) for name, rows in tables.items()}
    return Star.from_frames(spark, **stored)


JOBS = [
    baseline.segment_breakdown,
    baseline.country_breakdown,
    anomalies.velocity_pairs_top,
    anomalies.velocity_account_summary,
    anomalies.amount_outliers,
    anomalies.geo_mismatch_transactions,
    anomalies.geo_mismatch_by_customer,
    customers.customer_baseline,
    customers.quarter_spend_spike,
    customers.dormant_reactivation,
    merchants.merchant_overview,
    merchants.merchant_concentration,
    scoring.customer_risk_score_table,
]


@pytest.mark.parametrize("job", JOBS, ids=lambda job: job.__name__)
def test_results_do_not_depend_on_partitions_or_broadcasts(spark, hot_star, job):
    def run():
        return sorted(map(str, job(Star(spark, hot_star.table)).collect()))

    usual = run()
    settings = {
        "spark.sql.shuffle.partitions": "29",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert run() == usual
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_adaptive_execution_can_split_a_hot_customer(spark, hot_star):
    """Fact and dimension meet with a plain shuffle on either side, which AQE may divide."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        job = anomalies.geo_mismatch_transactions(Star(spark, hot_star.table))
        job.collect()
        plan = job._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert "skew=true" in plan
