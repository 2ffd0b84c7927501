"""Each registered job once more as plain SQL, by its definition rather than by the way the jobs run.

The star tables are derived in the statement itself, from the raw tables. Velocity is a self-join here,
quintiles are NTILE, running shares are a window and return dates are LAG over single rows.
"""

from __future__ import annotations

STAR = """
base AS (
  SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk, o.o_custkey AS ck,
         c.c_nationkey AS nk, l.l_extendedprice, l.l_returnflag, o.o_orderstatus,
         (l.l_orderkey*7919 + l.l_linenumber*1301 + l.l_partkey*31 + l.l_suppkey*17) % 1000 AS hl,
         (l.l_orderkey*7919) % 1000 AS ho,
         ((date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) % 274) + 274) % 274 AS dd
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
timed AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(dd*86400
      + CASE WHEN ho < 100 THEN 3600 + (ok*37) % 13500 ELSE 18000 + (ok*7919) % 63000 END
      + (ln-1)*125 AS BIGINT)) AS dt FROM base),
placed AS (
  SELECT *, CASE WHEN hour(dt) BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS off,
         CASE WHEN hl % 8 = 0 THEN (nk + 1 + hl % 7) % 25 ELSE nk END AS n,
         CAST((((ok::HUGEINT*8+ln)*1000000+pk)*100000+sk) % 9223372036854775807 AS BIGINT) AS tk FROM timed),
fact_transactions AS (
  SELECT tk AS transaction_key, 'T' || tk AS transaction_id, ck AS customer_key, ck*2 + ok % 2 AS account_key,
         CASE WHEN hl = 13 OR ck % 139 = 7 THEN -1 ELSE sk END AS merchant_key,
         CASE WHEN hl = 29 OR ck % 137 = 5 THEN -1 ELSE n*4 + ok % 4 END AS location_key,
         CAST(strftime(dt, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN hl = 7 THEN 12 ELSE 1 END AS DECIMAL(18,2)) AS amount_usd,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * CASE WHEN hl = 7 THEN 12 ELSE 1 END AS cents,
         CASE WHEN off = 1 AND hl % 10 < 3 THEN 1 WHEN ho % 25 = 0 AND hl % 10 < 7 THEN 1
              WHEN ck % 25 = 0 AND hl % 10 < 3 THEN 1 WHEN month(dt) >= 7 AND hl % 100 < 8 THEN 1
              WHEN hl % 100 < 2 THEN 1 ELSE 0 END AS is_flagged,
         off AS is_off_hours,
         CASE WHEN hl % 10 <= 3 THEN 'Mobile' WHEN hl % 10 <= 6 THEN 'Web' WHEN hl % 10 <= 8 THEN 'ATM' ELSE 'Branch' END AS channel,
         CASE l_returnflag WHEN 'A' THEN 'Purchase' WHEN 'N' THEN 'Transfer' WHEN 'R' THEN 'Withdrawal' END AS transaction_type,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Failed' END AS status,
         CAST(hour(dt) AS INTEGER) AS transaction_hour, CAST(dt AS DATE) AS transaction_date,
         dt AS transaction_datetime
  FROM placed),
dim_customer AS (
  SELECT c_custkey AS customer_key, 'C' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS customer_id, c_name AS full_name,
         CASE WHEN c_custkey % 59 = 0 THEN NULL ELSE n_name END AS country,
         CASE c_custkey % 10 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Unverified' WHEN 2 THEN 'Pending' ELSE 'Verified' END AS kyc_status,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Retail' WHEN 'AUTOMOBILE' THEN 'Retail' WHEN 'BUILDING' THEN 'SME'
              WHEN 'MACHINERY' THEN 'Corporate' WHEN 'FURNITURE' THEN 'Private' END AS customer_segment,
         CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE
           CASE c_custkey % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Web' WHEN 2 THEN 'ATM' ELSE 'Branch' END END AS preferred_channel
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
dim_account AS (
  SELECT c_custkey*2 + i AS account_key, 'A' || lpad(CAST(c_custkey*2 + i AS VARCHAR), CAST(greatest(7, length(CAST(c_custkey*2 + i AS VARCHAR))) AS INTEGER), '0') AS account_id,
         CASE (c_custkey + i) % 3 WHEN 0 THEN 'Savings' WHEN 1 THEN 'Current' ELSE 'Business' END AS account_type,
         CASE WHEN c_acctbal < 1000 THEN 'Low' WHEN c_acctbal < 5000 THEN 'Medium' ELSE 'High' END AS balance_tier
  FROM customer CROSS JOIN (VALUES (0), (1)) v(i)),
dim_merchant AS (
  SELECT s_suppkey AS merchant_key, s_name AS merchant_name,
         CASE s_suppkey % 6 WHEN 0 THEN 'Crypto' WHEN 1 THEN 'Wire transfer' WHEN 2 THEN 'Fintech'
              WHEN 3 THEN 'Gaming' WHEN 4 THEN 'Retail' ELSE 'Travel' END AS merchant_category,
         CASE WHEN s_suppkey % 10 = 0 THEN 'Critical' WHEN s_suppkey % 10 <= 2 THEN 'High'
              WHEN s_suppkey % 10 <= 5 THEN 'Medium' ELSE 'Low' END AS risk_rating,
         n_name AS country, CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS is_shell_merchant
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dim_location AS (
  SELECT CAST(n_nationkey*4 + i AS BIGINT) AS location_key, n_name AS country, n_name || '-' || i AS city, r_name AS region,
         CASE WHEN n_nationkey % 8 = 0 THEN 1 ELSE 0 END AS is_high_risk_country
  FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (0), (1), (2), (3)) v(i)),
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date,
         CAST(year(d) AS INTEGER) AS year_number, CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name,
         CAST(quarter(d) AS INTEGER) AS quarter_number, dayname(d) AS day_of_week,
         CASE WHEN dayofweek(d) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
  FROM (SELECT DATE '2024-01-01' + CAST(i AS INTEGER) AS d FROM range(274) r(i)))"""


def with_star(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([STAR.strip(), *ctes]) + "\n" + body.strip()


def nearest(top: str, bottom: str, scale: int = 1) -> str:
    """top * scale / bottom to the nearest whole number, for a top from 0; halves go up."""
    return f"((({2 * scale}::HUGEINT * ({top}) + ({bottom})) // (2 * nullif(({bottom}), 0))))"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"(CAST({nearest(part, whole, 100 * 10**digits)} AS DOUBLE) / {10**digits})"


def quot(top: str, bottom: str) -> str:
    return f"(CAST({nearest(top, bottom, 100)} AS DOUBLE) / 100)"


def money(cents: str) -> str:
    return f"(CAST({cents} AS DOUBLE) / 100)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def spread(x: str) -> str:
    """n * sum(x^2) - sum(x)^2 over a group of whole numbers."""
    return f"(count({x})::HUGEINT * sum({x}::HUGEINT * {x}) - sum({x}::HUGEINT) * sum({x}::HUGEINT))"


def sd(x: str) -> str:
    return f"CAST(floor(sqrt(CAST({spread(x)} AS DOUBLE)) / count({x}) + 0.5) AS BIGINT)"


MEASURES = {
    "n": f"{big('count(*)')} AS total_transactions",
    "uc": f"{big('count(DISTINCT t.customer_key)')} AS unique_customers",
    "tv": f"{money('sum(t.cents)')} AS total_value_usd",
    "av": f"(CAST({nearest('sum(t.cents)', 'count(t.cents)')} AS DOUBLE) / 100) AS average_amount_usd",
    "mn": f"{money('min(t.cents)')} AS min_transaction_usd",
    "mx": f"{money('max(t.cents)')} AS max_transaction_usd",
    "sd": f"(CAST({sd('t.cents')} AS DOUBLE) / 100) AS spend_volatility",
    "fc": f"{big('sum(t.is_flagged)')} AS flagged_count",
    "fp": f"{pct('sum(t.is_flagged)', 'count(*)')} AS flagged_percentage",
    "oc": f"{big('sum(t.is_off_hours)')} AS off_hours_count",
    "op": f"{pct('sum(t.is_off_hours)', 'count(*)')} AS off_hours_percentage",
}


def grouped(
    keys: str,
    measures: str,
    joins: str = "",
    where: str = "",
    having: str = "",
    order: str = "",
    more: str = "",
    group: str | None = None,
) -> str:
    """A grouped statement over the fact `t`; `keys` may carry aliases that `group` then names."""
    columns = ", ".join(([keys] if keys else []) + [MEASURES[m] for m in measures.split()] + ([more] if more else []))
    by = group if group is not None else keys
    return (
        f"SELECT {columns} FROM fact_transactions t {joins}"
        + (f" WHERE {where}" if where else "")
        + (f" GROUP BY {by}" if by else "")
        + (f" HAVING {having}" if having else "")
        + (f" ORDER BY {order}" if order else "")
    )


CUSTOMER = "JOIN dim_customer c ON t.customer_key = c.customer_key"
LOCATION = "JOIN dim_location l ON t.location_key = l.location_key"
MERCHANT = "JOIN dim_merchant m ON t.merchant_key = m.merchant_key"
ACCOUNT = "JOIN dim_account a ON t.account_key = a.account_key"
DATE = "JOIN dim_date d ON t.date_key = d.date_key"
USUAL = "n tv av fc fp"
RAPID = (
    "t1.account_key = t2.account_key AND epoch_us(t2.transaction_datetime) - epoch_us(t1.transaction_datetime) > 0"
    " AND (epoch_us(t2.transaction_datetime) - epoch_us(t1.transaction_datetime)) // 60000000 <= 10"
    " AND t1.transaction_id <> t2.transaction_id"
)

ORACLE: dict[str, str] = {}


def define(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = with_star(body, *ctes)


# Baseline key figures
define("q01_overall_summary", grouped("", "n tv av mn mx fc fp"))
define("q02_monthly_trend", grouped("d.year_number, d.month_number, d.month_name", USUAL, DATE))
define("q03_channel_breakdown", grouped("channel", USUAL))
define("q04_transaction_type_breakdown", grouped("transaction_type", USUAL))
define("q05_status_breakdown", grouped("status", "n tv fp"))
define("q06_hourly_distribution", grouped("transaction_hour", "n tv fc fp"))
define("q07_segment_breakdown", grouped("c.customer_segment", "uc " + USUAL, CUSTOMER))
define(
    "q08_weekend_vs_weekday",
    grouped("CASE WHEN d.is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type", USUAL, DATE, group="1"),
)
define("q09_day_of_week_breakdown", grouped("d.day_of_week, d.is_weekend", USUAL, DATE))
define("q10_country_breakdown", grouped("l.country, l.region", "uc " + USUAL, LOCATION))
define(
    "q11_city_hotspots",
    grouped("l.country, l.city", USUAL, LOCATION, order="flagged_count DESC, l.country, l.city LIMIT 20"),
)
define(
    "q12_high_risk_country_activity",
    grouped("l.country, l.city", "uc " + USUAL, LOCATION, where="l.is_high_risk_country = 1"),
)
define(
    "q13_high_risk_country_share",
    grouped(
        "CASE WHEN l.is_high_risk_country = 1 THEN 'High Risk Country' ELSE 'Normal Country' END AS country_risk",
        "n tv fc fp",
        LOCATION,
        more=f"{pct('sum(t.cents)', 'sum(sum(t.cents)) OVER ()')} AS percentage_of_total_value",
        group="1",
    ),
)
define("q14_account_type_breakdown", grouped("a.account_type, a.balance_tier", "uc mx " + USUAL, ACCOUNT))

# Anomalies and velocity
define("q15_off_hours_by_hour", grouped("transaction_hour", "uc " + USUAL, where="is_off_hours = 1"))
define(
    "q16_off_hours_vs_normal",
    grouped(
        "CASE WHEN is_off_hours = 1 THEN 'Off-Hours (1AM-4AM)' ELSE 'Normal Hours' END AS time_period",
        "uc mx " + USUAL,
        group="1",
    ),
)
define(
    "q17_off_hours_by_channel",
    grouped("channel", "tv av fc fp", where="is_off_hours = 1", more=f"{big('count(*)')} AS off_hours_transactions"),
)
FLAGGED = "f AS (SELECT * FROM fact_transactions WHERE is_flagged = 1)"
define(
    "q18_velocity_pairs",
    f"""SELECT t1.account_key, a.account_id, c.full_name, c.customer_segment, t1.transaction_id AS first_txn,
       t2.transaction_id AS second_txn, t1.transaction_datetime AS first_txn_time,
       t2.transaction_datetime AS second_txn_time,
       {big('(epoch_us(t2.transaction_datetime) - epoch_us(t1.transaction_datetime)) // 60000000')} AS minutes_apart,
       {money('t1.cents')} AS first_amount, {money('t2.cents')} AS second_amount,
       {money('t1.cents + t2.cents')} AS combined_amount, t1.channel
FROM f t1 JOIN f t2 ON {RAPID}
JOIN dim_account a ON t1.account_key = a.account_key JOIN dim_customer c ON t1.customer_key = c.customer_key
ORDER BY minutes_apart, t1.cents + t2.cents DESC, t1.transaction_key, t2.transaction_key LIMIT 50""",
    FLAGGED,
)
define(
    "q19_velocity_account_summary",
    f"""SELECT t1.account_key, a.account_id, c.full_name, c.customer_segment, {big('count(*)')} AS velocity_hits,
       {money('sum(t1.cents)')} AS total_value_usd,
       (CAST({nearest('sum(t1.cents)', 'count(t1.cents)')} AS DOUBLE) / 100) AS average_amount_usd,
       max(t1.transaction_datetime) AS last_seen
FROM f t1 JOIN f t2 ON {RAPID}
JOIN dim_account a ON t1.account_key = a.account_key JOIN dim_customer c ON t1.customer_key = c.customer_key
GROUP BY ALL ORDER BY velocity_hits DESC, t1.account_key, c.full_name, c.customer_segment LIMIT 20""",
    FLAGGED,
)
define(
    "q20_amount_outliers",
    f"""SELECT t.transaction_id, t.customer_key, c.full_name, c.customer_segment, t.transaction_datetime, t.channel,
       t.transaction_type, {money('t.cents')} AS transaction_amount, {money('u.mean')} AS customer_average_amount,
       {money('u.dev')} AS standard_deviation_amount, {quot('t.cents', 'u.mean')} AS times_above_average, t.is_flagged
FROM fact_transactions t JOIN usual u ON t.customer_key = u.customer_key {CUSTOMER}
WHERE t.cents >= u.mean + 3 * u.dev
ORDER BY times_above_average DESC NULLS LAST, t.transaction_key, t.cents LIMIT 50""",
    f"""usual AS (SELECT customer_key, {nearest('sum(cents)', 'count(cents)')} AS mean, {sd('cents')} AS dev
FROM fact_transactions GROUP BY customer_key)""",
)
define(
    "q21_daily_spikes",
    f"""SELECT transaction_date, {big('n')} AS daily_txn_count, {money('v')} AS daily_value, {big('f')} AS daily_flagged,
       {money('mean')} AS avg_daily_txns, {quot('100 * n', 'mean')} AS times_above_avg
FROM days CROSS JOIN stats WHERE 100 * n > mean + 2 * dev""",
    "days AS (SELECT transaction_date, count(*) AS n, sum(cents) AS v, sum(is_flagged) AS f"
    " FROM fact_transactions GROUP BY transaction_date)",
    f"stats AS (SELECT {nearest('sum(100 * n)', 'count(*)')} AS mean, {sd('(100 * n)')} AS dev FROM days)",
)
define(
    "q22_geo_mismatch_transactions",
    f"""SELECT t.transaction_id, c.customer_id, c.full_name, c.country AS home_country, l.country AS transaction_country,
       l.city AS transaction_city, l.is_high_risk_country, t.transaction_datetime, {money('t.cents')} AS amount_usd,
       t.channel, t.is_flagged
FROM fact_transactions t {CUSTOMER} {LOCATION} WHERE c.country <> l.country
ORDER BY l.is_high_risk_country DESC, t.cents DESC, t.transaction_key LIMIT 50""",
)
define(
    "q23_geo_mismatch_by_customer",
    grouped(
        "c.customer_id, c.full_name, c.country AS home_country",
        "tv fc",
        CUSTOMER + " " + LOCATION,
        where="c.country <> l.country",
        more=f"{big('count(*)')} AS mismatch_txn_count, {big('count(DISTINCT l.country)')} AS countries_transacted_in,"
        f" {big('sum(l.is_high_risk_country)')} AS high_risk_country_hits",
        group="c.customer_id, c.full_name, c.country",
        order="high_risk_country_hits DESC, mismatch_txn_count DESC, c.customer_id, c.full_name, home_country LIMIT 20",
    ),
)

# Customers
define(
    "q24_customer_baseline",
    grouped(
        "c.customer_id, c.full_name, c.customer_segment, c.country AS home_country, c.kyc_status, c.preferred_channel",
        "n tv av mx sd fc fp oc op",
        CUSTOMER,
        more=f"{big('count(DISTINCT t.account_key)')} AS accounts_used, min(t.transaction_date) AS first_transaction,"
        " max(t.transaction_date) AS last_transaction",
        group="c.customer_id, c.full_name, c.customer_segment, c.country, c.kyc_status, c.preferred_channel",
        order="flagged_count DESC, c.customer_id, c.full_name LIMIT 50",
    ),
)
define(
    "q25_high_risk_customers",
    "SELECT * FROM (" + grouped(
        "c.customer_id, c.full_name, c.customer_segment, c.kyc_status, c.country AS home_country",
        "n tv av fc fp oc op",
        CUSTOMER,
        group="c.customer_id, c.full_name, c.customer_segment, c.kyc_status, c.country",
    ) + ") WHERE flagged_percentage > 20 AND total_transactions >= 5"
    " ORDER BY flagged_percentage DESC, total_value_usd DESC, customer_id LIMIT 30",
)
define(
    "q26_unusual_channel_use",
    "SELECT * FROM (" + grouped(
        "c.customer_id, c.full_name, c.preferred_channel, t.channel AS channel_used",
        "tv fc fp",
        CUSTOMER,
        more=f"{big('count(*)')} AS transaction_count,"
        " CASE WHEN t.channel <> c.preferred_channel THEN 'Unusual Channel' ELSE 'Normal Channel' END AS channel_pattern",
        group="c.customer_id, c.full_name, c.preferred_channel, t.channel",
    ) + ") WHERE channel_pattern = 'Unusual Channel'"
    " ORDER BY flagged_count DESC, total_value_usd DESC, customer_id, full_name, preferred_channel, channel_used LIMIT 30",
)
define(
    "q27_quarter_spend_spike",
    f"""SELECT c.customer_id, c.full_name, c.customer_segment, m.month_name, m.quarter_number AS quarter,
       {money('m.spend')} AS monthly_spend, {big('m.n')} AS monthly_txn_count, {big('m.f')} AS monthly_flagged,
       {money('b.base')} AS q1_q2_baseline_spend, {quot('m.spend', 'b.base')} AS spend_multiplier
FROM monthly m JOIN baseline b ON m.customer_key = b.customer_key JOIN dim_customer c ON m.customer_key = c.customer_key
WHERE m.quarter_number = 3 AND m.spend > 2 * b.base
ORDER BY spend_multiplier DESC NULLS LAST, m.customer_key, m.month_number LIMIT 30""",
    f"""monthly AS (SELECT t.customer_key, d.month_number, d.month_name, d.quarter_number, sum(t.cents) AS spend,
      count(*) AS n, sum(t.is_flagged) AS f FROM fact_transactions t {DATE} GROUP BY ALL)""",
    f"baseline AS (SELECT customer_key, {nearest('sum(spend)', 'count(*)')} AS base FROM monthly"
    " WHERE quarter_number IN (1, 2) GROUP BY customer_key)",
)
ACTIVITY = """activity AS (SELECT *, lag(transaction_date) OVER (PARTITION BY customer_key
   ORDER BY transaction_date, transaction_datetime, transaction_key, cents) AS previous FROM fact_transactions)"""
define(
    "q28_dormant_reactivation",
    f"""SELECT c.customer_id, c.full_name, c.customer_segment, c.kyc_status, t.previous AS previous_transaction_date,
       t.transaction_date AS return_date, {big("date_diff('day', t.previous, t.transaction_date)")} AS days_dormant,
       {money('t.cents')} AS return_transaction_amount, t.channel, t.is_flagged
FROM activity t {CUSTOMER} WHERE date_diff('day', t.previous, t.transaction_date) >= 60
ORDER BY days_dormant DESC, t.cents DESC, t.transaction_key LIMIT 30""",
    ACTIVITY,
)
define(
    "q29_kyc_breakdown",
    grouped(
        "c.kyc_status", "n tv av mx fc fp", CUSTOMER, more=f"{big('count(DISTINCT c.customer_id)')} AS unique_customers"
    ),
)
define(
    "q30_customer_watchlist",
    grouped(
        "c.customer_id, c.full_name, c.customer_segment, c.kyc_status, c.country AS home_country",
        "n tv fc fp oc",
        CUSTOMER + " " + LOCATION,
        more=f"{big('sum(CASE WHEN c.country <> l.country THEN 1 ELSE 0 END)')} AS geo_mismatch_count,"
        f" {big('sum(CASE WHEN l.is_high_risk_country = 1 THEN 1 ELSE 0 END)')} AS high_risk_country_hits,"
        " CASE WHEN c.kyc_status IN ('Unverified', 'Expired') THEN 'YES' ELSE 'NO' END AS poor_kyc",
        group="c.customer_id, c.full_name, c.customer_segment, c.kyc_status, c.country",
        order="flagged_count DESC, geo_mismatch_count DESC, high_risk_country_hits DESC, c.customer_id LIMIT 20",
    ),
)

# Merchants and channels
define(
    "q31_merchant_overview",
    grouped(
        "m.merchant_name, m.merchant_category, m.risk_rating, m.country AS merchant_country, m.is_shell_merchant",
        "uc mx oc " + USUAL,
        MERCHANT,
        group="m.merchant_name, m.merchant_category, m.risk_rating, m.country, m.is_shell_merchant",
    ),
)
define(
    "q32_merchant_risk_ranking",
    grouped(
        "m.merchant_name, m.merchant_category, m.risk_rating, m.is_shell_merchant",
        "n tv fc fp oc op",
        MERCHANT,
        more=quot("50 * sum(t.is_flagged) + 30 * sum(t.is_off_hours) + 20 * m.is_shell_merchant * count(*)", "count(*)")
        + " AS merchant_risk_score",
        group="m.merchant_name, m.merchant_category, m.risk_rating, m.is_shell_merchant",
    ),
)
define(
    "q33_shell_merchants",
    grouped(
        "m.merchant_name, m.merchant_category, m.country AS merchant_country, m.risk_rating",
        "uc " + USUAL,
        MERCHANT,
        where="m.is_shell_merchant = 1",
        group="m.merchant_name, m.merchant_category, m.country, m.risk_rating",
    ),
)
define(
    "q34_merchant_category_summary",
    grouped(
        "m.merchant_category",
        "uc oc op " + USUAL,
        MERCHANT,
        more=f"{big('count(DISTINCT m.merchant_name)')} AS merchant_count",
    ),
)
define(
    "q35_channel_risk_score",
    grouped(
        "t.channel",
        "uc mx oc op " + USUAL,
        more=quot("60 * sum(t.is_flagged) + 40 * sum(t.is_off_hours)", "count(*)") + " AS channel_risk_score",
    ),
)
define(
    "q36_channel_monthly_trend",
    grouped(
        "t.channel, d.month_name, d.month_number, d.quarter_number AS quarter",
        "n tv fc fp",
        DATE,
        group="t.channel, d.month_name, d.month_number, d.quarter_number",
    ),
)
define(
    "q37_merchant_customer_overlap",
    grouped(
        "m.merchant_name, m.merchant_category, m.risk_rating, m.is_shell_merchant, c.customer_id, c.full_name,"
        " c.customer_segment, c.kyc_status",
        "tv fc fp",
        MERCHANT + " " + CUSTOMER,
        where="m.risk_rating IN ('High', 'Critical') OR m.is_shell_merchant = 1",
        having="sum(t.is_flagged) > 0",
        more=f"{big('count(*)')} AS transactions_together",
        order="flagged_count DESC, total_value_usd DESC, m.merchant_name, c.customer_id LIMIT 30",
    ),
)
define(
    "q38_merchant_concentration",
    f"""SELECT merchant_name, merchant_category, risk_rating, {big('fc')} AS flagged_count, {money('v')} AS total_value_usd,
       {pct('fc', 'total')} AS percentage_of_all_fraud, {pct('running', 'total')} AS cumulative_fraud_percentage
FROM (SELECT *, sum(fc) OVER (ORDER BY fc DESC) AS running, sum(fc) OVER () AS total FROM mf)
ORDER BY fc DESC, merchant_name, merchant_category, risk_rating LIMIT 20""",
    f"""mf AS (SELECT m.merchant_name, m.merchant_category, m.risk_rating, sum(t.is_flagged) AS fc, sum(t.cents) AS v
FROM fact_transactions t {MERCHANT} GROUP BY ALL)""",
)

# Scoring
STATS = f"""moments AS (SELECT customer_key, count(cents) AS n, sum(cents) AS s, {spread('cents')} AS var
FROM fact_transactions GROUP BY customer_key)"""
VELOCITY = f"""velocity AS (SELECT t1.customer_key, count(*) AS hits FROM fact_transactions t1
JOIN fact_transactions t2 ON {RAPID} AND t1.is_flagged = 1 GROUP BY t1.customer_key)"""
# x >= mean + 3 deviations, without a square root: n*x - sum(x) is from 0 and its square from 9 * var.
BEYOND = (
    "m.n::HUGEINT * t.cents - m.s >= 0 AND"
    " (m.n::HUGEINT * t.cents - m.s) * (m.n::HUGEINT * t.cents - m.s) >= 9 * m.var"
)
SIGNALS = (
    STATS,
    VELOCITY,
    f"""fs AS (SELECT customer_key, count(*) AS total_txns, sum(is_flagged) AS flagged_count,
      {pct('sum(is_flagged)', 'count(*)')} AS flagged_pct, {pct('sum(is_off_hours)', 'count(*)')} AS off_hours_pct
      FROM fact_transactions GROUP BY customer_key)""",
    f"""gs AS (SELECT t.customer_key, sum(CASE WHEN c.country <> l.country THEN 1 ELSE 0 END) AS geo_mismatch_count,
      sum(CASE WHEN l.is_high_risk_country = 1 THEN 1 ELSE 0 END) AS high_risk_country_count
      FROM fact_transactions t {CUSTOMER} {LOCATION} GROUP BY t.customer_key)""",
    f"""ss AS (SELECT t.customer_key,
      {pct('sum(CASE WHEN m.is_shell_merchant = 1 THEN 1 ELSE 0 END)', 'count(*)')} AS shell_txn_pct
      FROM fact_transactions t {MERCHANT} GROUP BY t.customer_key)""",
    f"""ams AS (SELECT t.customer_key, sum(CASE WHEN {BEYOND} THEN 1 ELSE 0 END) AS outlier_txn_count
      FROM fact_transactions t JOIN moments m ON t.customer_key = m.customer_key GROUP BY t.customer_key)""",
    """combined AS (SELECT fs.*, gs.geo_mismatch_count, gs.high_risk_country_count, ss.shell_txn_pct,
      ams.outlier_txn_count, coalesce(v.hits, 0) AS velocity_hit_count
      FROM fs LEFT JOIN gs ON fs.customer_key = gs.customer_key LEFT JOIN ss ON fs.customer_key = ss.customer_key
      LEFT JOIN ams ON fs.customer_key = ams.customer_key LEFT JOIN velocity v ON fs.customer_key = v.customer_key)""",
    """long AS (SELECT customer_key, unnest([
      {'signal': 'flagged', 'amount': flagged_pct}, {'signal': 'off_hours', 'amount': off_hours_pct},
      {'signal': 'geo', 'amount': geo_mismatch_count::DOUBLE}, {'signal': 'country', 'amount': high_risk_country_count::DOUBLE},
      {'signal': 'shell', 'amount': shell_txn_pct}, {'signal': 'outlier', 'amount': outlier_txn_count::DOUBLE},
      {'signal': 'velocity', 'amount': velocity_hit_count::DOUBLE}], recursive := true) FROM combined)""",
    """ranked AS (SELECT *, ntile(5) OVER (PARTITION BY signal ORDER BY amount NULLS FIRST, customer_key NULLS FIRST) AS fifth
      FROM long)""",
    """weights(signal, weight) AS (VALUES ('flagged', 6), ('velocity', 4), ('off_hours', 3), ('geo', 3), ('shell', 2),
      ('country', 1), ('outlier', 1))""",
    "ntiles AS (SELECT customer_key, "
    + ", ".join(
        f"CAST(max(fifth) FILTER (signal = '{signal}') AS INTEGER) AS {score}"
        for signal, score in {
            "flagged": "flagged_score",
            "off_hours": "off_hours_score",
            "geo": "geo_score",
            "country": "high_risk_country_score",
            "shell": "shell_score",
            "outlier": "outlier_score",
            "velocity": "velocity_score",
        }.items()
    )
    + ", CAST(sum(fifth * weight) AS BIGINT) AS composite_risk_score FROM ranked JOIN weights USING (signal)"
    " GROUP BY customer_key)",
    """scored AS (SELECT combined.*, ntiles.* EXCLUDE (customer_key), CASE WHEN composite_risk_score >= 80 THEN 'CRITICAL'
      WHEN composite_risk_score >= 60 THEN 'HIGH' WHEN composite_risk_score >= 40 THEN 'MEDIUM'
      WHEN composite_risk_score >= 20 THEN 'LOW' ELSE 'MINIMAL' END AS risk_tier
      FROM combined JOIN ntiles ON combined.customer_key IS NOT DISTINCT FROM ntiles.customer_key)""",
)
define(
    "q39_customer_amount_stats",
    """SELECT customer_key, avg_amount, stddev_amount, avg_amount + stddev_amount * 3 AS outlier_threshold
FROM (SELECT customer_key, CAST(s AS DOUBLE) / (CAST(n AS DOUBLE) * 100) AS avg_amount,
      sqrt(CAST(var AS DOUBLE)) / (CAST(n AS DOUBLE) * 100) AS stddev_amount FROM moments)""",
    STATS,
)
define(
    "q40_customer_velocity_hits", f"SELECT customer_key, {big('hits')} AS velocity_hit_count FROM velocity", VELOCITY
)
WATCHLIST = f"""SELECT c.customer_id, c.full_name, c.customer_segment, c.kyc_status, c.country AS home_country,
  s.flagged_pct, s.off_hours_pct, {big('s.geo_mismatch_count')} AS geo_mismatches,
  {big('s.high_risk_country_count')} AS high_risk_country_txns, s.shell_txn_pct AS shell_merchant_pct,
  {big('s.outlier_txn_count')} AS amount_outliers, {big('s.velocity_hit_count')} AS velocity_hits,
  s.composite_risk_score, s.risk_tier
FROM scored s JOIN dim_customer c ON s.customer_key = c.customer_key
ORDER BY s.composite_risk_score DESC, s.customer_key LIMIT """
define("q41_top_risk_customers", WATCHLIST + "50", *SIGNALS)
define(
    "q42_risk_tier_summary",
    f"""SELECT risk_tier, {big('count(*)')} AS customer_count,
       {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_customers FROM scored GROUP BY risk_tier""",
    *SIGNALS,
)
define(
    "s1_flagged_signal",
    f"SELECT customer_key, {big('total_txns')} AS total_txns, {big('flagged_count')} AS flagged_count, flagged_pct,"
    " off_hours_pct FROM fs",
    *SIGNALS,
)
define(
    "s2_geo_signal",
    f"SELECT customer_key, {big('geo_mismatch_count')} AS geo_mismatch_count,"
    f" {big('high_risk_country_count')} AS high_risk_country_count FROM gs",
    *SIGNALS,
)
define("s3_shell_signal", "SELECT customer_key, shell_txn_pct FROM ss", *SIGNALS)
define(
    "s4_amount_signal", f"SELECT customer_key, {big('outlier_txn_count')} AS outlier_txn_count FROM ams", *SIGNALS
)
define(
    "s5_combined_signals",
    f"""SELECT customer_key, {big('total_txns')} AS total_txns, {big('flagged_count')} AS flagged_count, flagged_pct,
       off_hours_pct, {big('geo_mismatch_count')} AS geo_mismatch_count,
       {big('high_risk_country_count')} AS high_risk_country_count, shell_txn_pct,
       {big('outlier_txn_count')} AS outlier_txn_count, {big('velocity_hit_count')} AS velocity_hit_count FROM combined""",
    *SIGNALS,
)
QUINTILES = (
    "customer_key, flagged_score, off_hours_score, geo_score, high_risk_country_score, shell_score, outlier_score,"
    " velocity_score"
)
define("s6_ntile_scores", f"SELECT {QUINTILES} FROM ntiles", *SIGNALS)
define("s7_composite_score", "SELECT customer_key, composite_risk_score FROM ntiles", *SIGNALS)
define("s8_risk_tier", "SELECT customer_key, risk_tier FROM scored", *SIGNALS)

# Dashboard tables
SUSPICIOUS = f"{money('sum(CASE WHEN t.is_flagged = 1 THEN t.cents END)')} AS suspicious_value_usd"
define("d01_kpi_cards", grouped("", "n tv fp", more=SUSPICIOUS))
define("d01_kpi_cards_q3", grouped("", "n tv fp", DATE, where="d.quarter_number = 3", more=SUSPICIOUS))
define("d01_kpi_cards_mobile", grouped("", "n tv fp", where="t.channel = 'Mobile'", more=SUSPICIOUS))
define(
    "d01_kpi_cards_q2_web",
    grouped("", "n tv fp", DATE, where="d.quarter_number = 2 AND t.channel = 'Web'", more=SUSPICIOUS),
)
define("d02_monthly_volume", grouped("d.year_number, d.month_number, d.month_name", "n fc", DATE))
define("d03_flagged_pct_by_channel", grouped("channel", "fp"))
define(
    "d04_monthly_kpi_banded",
    "SELECT *, CASE WHEN flagged_percentage > 10 THEN 'red' WHEN flagged_percentage > 5 THEN 'amber' ELSE 'green' END"
    " AS band FROM ("
    + grouped(
        "d.year_number, d.month_number, d.month_name",
        "n tv fc",
        DATE,
        more=f"{pct('sum(t.is_flagged)', 'count(*)', 1)} AS flagged_percentage",
        group="d.year_number, d.month_number, d.month_name",
    )
    + ")",
)
define(
    "d05_segment_value_share",
    grouped(
        "c.customer_segment",
        "tv",
        CUSTOMER,
        more=f"{pct('sum(t.cents)', 'sum(sum(t.cents)) OVER ()')} AS percentage_of_total_value",
    ),
)
define(
    "d06_off_hours_kpis",
    f"""SELECT {big('sum(is_off_hours)')} AS off_hours_transactions,
  {pct('sum(is_flagged) FILTER (is_off_hours = 1)', 'count(*) FILTER (is_off_hours = 1)')} AS off_hours_flagged_percentage,
  {pct('sum(is_flagged) FILTER ((is_off_hours = 1) IS NOT TRUE)', 'count(*) FILTER ((is_off_hours = 1) IS NOT TRUE)')} AS normal_flagged_percentage
FROM fact_transactions""",
)
define(
    "d07_geo_mismatch_total",
    f"SELECT {big('count(*)')} AS geo_mismatches FROM fact_transactions t {CUSTOMER} {LOCATION}"
    " WHERE c.country <> l.country",
)
define(
    "d08_shell_txn_total",
    f"SELECT {big('count(*)')} AS shell_merchant_transactions FROM fact_transactions t {MERCHANT}"
    " WHERE m.is_shell_merchant = 1",
)
define(
    "d09_hour_flag_histogram",
    f"""SELECT CAST(h AS INTEGER) AS transaction_hour, {big('coalesce(sum(t.is_flagged), 0)')} AS flagged_count,
       {big('count(t.transaction_key) - coalesce(sum(t.is_flagged), 0)')} AS unflagged_count
FROM range(24) r(h) LEFT JOIN fact_transactions t ON t.transaction_hour = h GROUP BY h""",
)
define("d10_flagged_pct_by_category", grouped("m.merchant_category", "fp", MERCHANT))
define(
    "d11_merchant_risk_table",
    "SELECT merchant_name, merchant_category, CASE WHEN is_shell_merchant = 1 THEN 'Yes' ELSE 'No' END AS shell,"
    " risk_rating, flagged_percentage FROM ("
    + grouped(
        "m.merchant_name, m.merchant_category, m.risk_rating, m.country, m.is_shell_merchant",
        "fp",
        MERCHANT,
    )
    + ") ORDER BY flagged_percentage DESC, merchant_name, merchant_category, risk_rating, country, is_shell_merchant LIMIT 6",
)
define(
    "d12_channel_hours_matrix",
    f"""SELECT channel, {big('count(*) FILTER (is_off_hours = 1)')} AS off_hours_transactions,
       {big('count(*) FILTER ((is_off_hours = 1) IS NOT TRUE)')} AS normal_transactions FROM fact_transactions GROUP BY channel""",
)
define(
    "d13_tier_kpis",
    f"""SELECT {big("count(*) FILTER (risk_tier = 'CRITICAL')")} AS critical_customers,
       {big("count(*) FILTER (risk_tier = 'HIGH')")} AS high_customers FROM scored""",
    *SIGNALS,
)
define(
    "d14_poor_kyc_customers",
    f"SELECT {big('count(DISTINCT customer_id)')} AS poor_kyc_customers FROM dim_customer"
    " WHERE kyc_status IN ('Unverified', 'Expired')",
)
define(
    "d15_dormant_customer_total",
    f"SELECT {big('count(DISTINCT t.customer_key)')} AS dormant_reactivations FROM activity t {CUSTOMER}"
    " WHERE date_diff('day', t.previous, t.transaction_date) >= 60",
    ACTIVITY,
)
define("d16_flagged_pct_by_kyc", grouped("c.kyc_status", "fp", CUSTOMER))
define(
    "d17_tier_distribution",
    f"""SELECT v.risk_tier, {big('count(s.composite_risk_score)')} AS customer_count
FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('MINIMAL')) v(risk_tier)
LEFT JOIN scored s ON s.risk_tier = v.risk_tier GROUP BY v.risk_tier""",
    *SIGNALS,
)
define(
    "d18_watchlist_top10",
    "SELECT customer_id, full_name, customer_segment, kyc_status, flagged_pct, geo_mismatches, velocity_hits,"
    f" composite_risk_score, risk_tier FROM ({WATCHLIST}10)",
    *SIGNALS,
)
define(
    "d19_quarter_change",
    f"""SELECT year_number, quarter_number, {big('fc')} AS flagged_count,
       CAST(sign(fc - prev) * {nearest('abs(fc - prev)', 'prev', 10000)} AS DOUBLE) / 100 AS change_percentage
FROM (SELECT *, lag(fc) OVER (ORDER BY year_number, quarter_number) AS prev FROM
  (SELECT d.year_number, d.quarter_number, sum(t.is_flagged) AS fc FROM fact_transactions t {DATE} GROUP BY ALL))""",
)

# Loading and audits
define(
    "a1_load_csv_table",
    f"""SELECT 'accepted' AS load_state, channel, {big('count(*)')} AS row_count, {money('sum(cents)')} AS total_value_usd
FROM fact_transactions WHERE transaction_key % 997 <> 0 GROUP BY channel
UNION ALL SELECT 'rejected', NULL, {big('count(*)')}, NULL FROM fact_transactions WHERE transaction_key % 997 = 0""",
)
define(
    "a2_orphan_audit",
    " UNION ALL ".join(
        f"""SELECT 'dim_{d}' AS dimension, {big(f'count(*) FILTER (t.{d}_key IS NULL)')} AS missing_key_rows,
  {big(f'count(*) FILTER (t.{d}_key IS NOT NULL AND t.{d}_key NOT IN (SELECT {d}_key FROM dim_{d}))')} AS unknown_key_rows
FROM fact_transactions t"""
        for d in ("customer", "account", "merchant", "location", "date")
    ),
)
define("a3_customer_risk_scores", f"SELECT {QUINTILES}, composite_risk_score, risk_tier FROM scored", *SIGNALS)
define(
    "a4_reference_number_check",
    f"""SELECT check_name, {big('found')} AS found, {big('wanted')} AS wanted, {big('found - wanted')} AS difference,
       CASE WHEN found = wanted THEN 1 ELSE 0 END AS agrees FROM (
  SELECT 'transactions by channel' AS check_name, (SELECT count(*) FROM fact_transactions WHERE channel IS NOT NULL) AS found,
         (SELECT count(*) FROM fact_transactions) AS wanted
  UNION ALL SELECT 'transactions by hour', (SELECT count(*) FROM fact_transactions WHERE transaction_hour BETWEEN 0 AND 23),
         (SELECT count(*) FROM fact_transactions)
  UNION ALL SELECT 'transactions by month', (SELECT count(*) FROM fact_transactions t {DATE}),
         (SELECT count(*) FROM fact_transactions)
  UNION ALL SELECT 'transactions by type', (SELECT count(*) FROM fact_transactions WHERE transaction_type IS NOT NULL),
         (SELECT count(*) FROM fact_transactions)
  UNION ALL SELECT 'customers by risk tier', (SELECT count(*) FROM scored),
         (SELECT count(*) FROM (SELECT DISTINCT customer_key FROM fact_transactions)))""",
    *SIGNALS,
)
