"""Rounding and moments against whole-number arithmetic in Python."""

from __future__ import annotations

import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.operators.rollup import summarise


def half_away(value: Fraction, digits: int) -> float:
    scaled = abs(value) * 10**digits
    whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return math.copysign(float(Fraction(whole, 10**digits)), value) if whole else 0.0


def test_percentages_on_denominators_rich_in_ties(spark):
    cases = [(k, n) for n in (32, 160, 800, 4000, 20000) for k in range(0, n + 1, max(1, n // 300))]
    rows = (
        spark.createDataFrame(cases, "k long, n long")
        .select("k", "n", exact.percent(F.col("k"), F.col("n")).alias("p"),
                exact.percent(F.col("k"), F.col("n"), 1).alias("p1"))
        .collect()
    )
    for k, n, p, p1 in rows:
        assert p == half_away(Fraction(100 * k, n), 2)
        assert p1 == half_away(Fraction(100 * k, n), 1)


def test_ratios_of_either_sign_and_by_zero(spark):
    cases = [(-1, 8), (1, 8), (-3, 8), (5, -8), (7, 0), (None, 3)]
    rows = spark.createDataFrame(cases, "a long, b long").select(
        "a", "b", exact.ratio(F.col("a"), F.col("b")).alias("r")
    )
    for a, b, r in rows.collect():
        assert r == (None if a is None or b == 0 else half_away(Fraction(a, b), 2))


def test_population_deviation_of_two_amounts(mini):
    star = mini([{"amount_usd": 1}, {"amount_usd": 3}])
    row = summarise(star.fact, ["customer_key"], ("spend_volatility", "average_amount_usd")).first()
    assert (row["spend_volatility"], row["average_amount_usd"]) == (1.0, 2.0)


@pytest.mark.parametrize("low, high", [(0, 10**4), (-(10**6), 10**6), (10**9, 10**12), (0, 10**15)])
def test_moments_and_outlier_limit(spark, low, high):
    rng = random.Random(7)
    groups = {g: [rng.randint(low, high) for _ in range(rng.choice([1, 2, 5, 40]))] for g in range(40)}
    groups[40] = [high] * 7
    rows = [(g, Decimal(c) / 100) for g, cents in groups.items() for c in cents]
    frame = exact.with_cents(spark.createDataFrame(rows, "g int, amount_usd decimal(18,2)"))
    units, rest = exact.value_sums(F.col("row_cents"))
    sums = frame.groupBy("g").agg(
        F.count("amount_usd").alias("n"),
        exact.total_hundredths(units, rest).alias("s"),
        exact.total_squares(*exact.square_sums()).alias("q"),
    )
    limited = exact.with_outlier_limit(sums, F.col("n"), F.col("s"), F.col("q"), "limit")
    for g, n, s, q, limit in limited.select("g", "n", "s", "q", "limit").collect():
        cents = groups[g]
        assert (n, s, q) == (len(cents), sum(cents), sum(c * c for c in cents))
        s, q = int(s), int(q)
        root = math.isqrt(9 * (n * q - s * s))
        reach = root if root * root == 9 * (n * q - s * s) else root + 1
        assert limit == -((-(s + reach)) // n)


def test_totals_beyond_bigint_hundredths(spark):
    rows = [(Decimal("9999999999999999.99"),)] * 20
    frame = exact.with_cents(spark.createDataFrame(rows, "amount_usd decimal(18,2)"))
    total = frame.agg(exact.total_hundredths(*exact.value_sums(F.col("row_cents")))).first()[0]
    assert total == 20 * 999999999999999999


def test_epoch_does_not_depend_on_the_session_zone(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.000001' AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert frame.select(exact.epoch_micros(F.col("t"))).first()[0] == 1710037800000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
