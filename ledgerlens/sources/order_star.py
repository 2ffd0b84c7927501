"""A bank star schema derived from order, line-item, customer and supplier tables.

The mapping (FIXTURES.md) turns every line item into one transaction. Each star
table is derived by Spark on first use, written to the shared folder and read
back, so that jobs scan a stored fact table as they would in production.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.hot_keys import broadcast_by_rows
from ledgerlens.session import new_table_path, write_table
from ledgerlens.sources.csv_load import NULL_FIELD
from ledgerlens.sources.schema import SCHEMAS
from ledgerlens.sources.star import Star

FIRST_DAY = "2024-01-01"
DAYS = 274


def _pick(index: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), index.cast("int") + 1)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _conform(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def _padded(key: Column, digits: int) -> Column:
    """A key as text with leading zeros; longer keys are kept whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def _transaction_key(order: Column, line: Column, part: Column, supplier: Column) -> Column:
    """The four keys side by side, brought back into the range of a BIGINT: modulo 2^63 - 1.

    Keys of usual size need no wide arithmetic: the three leading ones fit a BIGINT, and their product with 100000 is
    taken in halves, of which the upper one, a multiple of 2^32, is turned within 63 bits.
    """
    wide = "decimal(38,0)"
    side_by_side = (order.cast(wide) * 8 + line).cast(wide) * 1000000 + part
    side_by_side = side_by_side.cast(wide) * 100000 + supplier
    any_size = (side_by_side.cast(wide) % F.lit(2**63 - 1).cast(wide)).cast("bigint")
    leading = (order.cast("bigint") * 8 + line) * 1000000 + part
    low = leading.bitwiseAND((1 << 32) - 1) * 100000
    high = F.shiftrightunsigned(leading, 32) * 100000
    turned = F.call_function("shiftleft", high.bitwiseAND((1 << 31) - 1), F.lit(32)) + (F.shiftrightunsigned(high, 31) - (2**63 - 1))
    beyond = turned + (low + supplier)
    usual = order.between(0, 1 << 38) & line.between(0, 1 << 20) & part.between(0, 1 << 40) & supplier.between(0, 1 << 40)
    return F.when(usual, F.pmod(beyond, F.lit(2**63 - 1))).otherwise(any_size)


def _fact_transactions(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    order, line, part, supplier, buyer = map(
        F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey")
    )
    mix, order_mix = F.col("mix"), F.col("order_mix")
    day = F.pmod(F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01"))), F.lit(DAYS)).cast("bigint")
    clock = F.when(order_mix < 100, 3600 + (order * 37) % 13500).otherwise(18000 + (order * 7919) % 63000)
    second = F.col("day") * 86400 + clock + (line - 1) * 125
    moment = F.lit(f"{FIRST_DAY} 00:00:00").cast("timestamp_ntz") + F.lit(datetime.timedelta(seconds=1)) * second
    # Orders meet customers first, as they are fewer than line items: these move once, and narrow.
    placed = orders.select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("day")).join(
        broadcast_by_rows(customer.select("c_custkey", "c_nationkey")), buyer == F.col("c_custkey")
    )
    price = F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    rows = (
        lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", price, "l_returnflag")
        .join(placed, order == F.col("o_orderkey"))
        .withColumns(
            {
                "mix": (order * 7919 + line * 1301 + part * 31 + supplier * 17) % 1000,
                "order_mix": (order * 7919) % 1000,
            }
        )
        .withColumn("transaction_datetime", moment)
        .withColumns(
            {
                "transaction_date": F.to_date("transaction_datetime"),
                "transaction_hour": F.hour("transaction_datetime"),
                "transaction_key": _transaction_key(order, line, part, supplier),
            }
        )
        .withColumn("is_off_hours", _flag(F.col("transaction_hour").between(1, 4)))
    )
    nation = F.when(mix % 8 == 0, (F.col("c_nationkey") + 1 + mix % 7) % 25).otherwise(F.col("c_nationkey"))
    suspicious = (
        ((F.col("is_off_hours") == 1) & (mix % 10 < 3))
        | ((order_mix % 25 == 0) & (mix % 10 < 7))
        | ((buyer % 25 == 0) & (mix % 10 < 3))
        | ((F.month("transaction_date") >= 7) & (mix % 100 < 8))
        | (mix % 100 < 2)
    )
    channel = F.when(mix % 10 < 4, "Mobile").when(mix % 10 < 7, "Web").when(mix % 10 < 9, "ATM").otherwise("Branch")
    kind = F.when(F.col("l_returnflag") == "A", "Purchase").when(F.col("l_returnflag") == "N", "Transfer")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Pending")
    return rows.withColumns(
        {
            "transaction_id": F.concat(F.lit("T"), F.col("transaction_key").cast("string")),
            "customer_key": buyer,
            "account_key": buyer * 2 + order % 2,
            "merchant_key": F.when((mix == 13) | (buyer % 139 == 7), -1).otherwise(supplier),
            "location_key": F.when((mix == 29) | (buyer % 137 == 5), -1).otherwise(nation * 4 + order % 4),
            "date_key": F.year("transaction_date") * 10000 + F.month("transaction_date") * 100 + F.day("transaction_date"),
            "amount_usd": F.when(mix == 7, (F.col("price") * 12).cast("decimal(18,2)")).otherwise(F.col("price")),
            "is_flagged": _flag(suspicious),
            "channel": channel,
            "transaction_type": kind.when(F.col("l_returnflag") == "R", "Withdrawal"),
            "status": status.when(F.col("o_orderstatus") == "P", "Failed"),
        }
    )


def _dim_customer(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    kyc = F.when(key % 10 == 0, "Expired").when(key % 10 == 1, "Unverified").when(key % 10 == 2, "Pending")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("customer_key"),
        F.concat(F.lit("C"), _padded(key, 6)).alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.when(key % 59 != 0, F.col("n_name")).alias("country"),
        kyc.otherwise("Verified").alias("kyc_status"),
        F.when(segment.isin("HOUSEHOLD", "AUTOMOBILE"), "Retail")
        .when(segment == "BUILDING", "SME")
        .when(segment == "MACHINERY", "Corporate")
        .when(segment == "FURNITURE", "Private")
        .alias("customer_segment"),
        F.when(key % 53 != 0, _pick(key % 4, ["Mobile", "Web", "ATM", "Branch"])).alias("preferred_channel"),
    )


def _dim_account(customer: DataFrame) -> DataFrame:
    accounts = customer.select("c_custkey", "c_acctbal", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    key = F.col("c_custkey") * 2 + F.col("i")
    balance = F.col("c_acctbal")
    return accounts.select(
        key.alias("account_key"),
        F.concat(F.lit("A"), _padded(key, 7)).alias("account_id"),
        _pick((F.col("c_custkey") + F.col("i")) % 3, ["Savings", "Current", "Business"]).alias("account_type"),
        F.when(balance < 1000, "Low").when(balance < 5000, "Medium").otherwise("High").alias("balance_tier"),
        F.lit("Active").alias("account_status"),
    )


def _dim_merchant(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    categories = ["Crypto", "Wire transfer", "Fintech", "Gaming", "Retail", "Travel"]
    rating = F.when(key % 10 == 0, "Critical").when(key % 10 <= 2, "High").when(key % 10 <= 5, "Medium")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("merchant_key"),
        F.col("s_name").alias("merchant_name"),
        _pick(key % 6, categories).alias("merchant_category"),
        rating.otherwise("Low").alias("risk_rating"),
        F.col("n_name").alias("country"),
        _flag(key % 11 == 0).alias("is_shell_merchant"),
    )


def _dim_location(nation: DataFrame, region: DataFrame) -> DataFrame:
    cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn(
        "i", F.explode(F.array(*map(F.lit, range(4))))
    )
    return cities.select(
        (F.col("n_nationkey") * 4 + F.col("i")).alias("location_key"),
        F.col("n_name").alias("country"),
        F.concat_ws("-", "n_name", F.col("i").cast("string")).alias("city"),
        F.col("r_name").alias("region"),
        _flag(F.col("n_nationkey") % 8 == 0).alias("is_high_risk_country"),
    )


def _dim_date(spark: SparkSession) -> DataFrame:
    days = spark.range(DAYS, numPartitions=1).select(
        F.date_add(F.to_date(F.lit(FIRST_DAY)), F.col("id").cast("int")).alias("full_date")
    )
    return days.select(
        F.date_format("full_date", "yyyyMMdd").alias("date_key"),
        "full_date",
        F.year("full_date").alias("year_number"),
        F.month("full_date").alias("month_number"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.quarter("full_date").alias("quarter_number"),
        F.date_format("full_date", "EEEE").alias("day_of_week"),
        _flag(F.dayofweek("full_date").isin(1, 7)).alias("is_weekend"),
    )


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One star table, as a plan over the Parquet tables in `folder`."""

    def raw(table: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{table}.parquet")

    builders = {
        "fact_transactions": lambda: _fact_transactions(raw("lineitem"), raw("orders"), raw("customer")),
        "dim_customer": lambda: _dim_customer(raw("customer"), raw("nation")),
        "dim_account": lambda: _dim_account(raw("customer")),
        "dim_merchant": lambda: _dim_merchant(raw("supplier"), raw("nation")),
        "dim_location": lambda: _dim_location(raw("nation"), raw("region")),
        "dim_date": lambda: _dim_date(spark),
    }
    return _conform(builders[name](), name)


_STARS: dict[tuple[str, str], Star] = {}


def order_star(spark: SparkSession, folder: str) -> Star:
    """The star of `folder`, derived once per Spark application."""
    identity = (spark.sparkContext.applicationId, folder)
    if identity not in _STARS:
        _STARS[identity] = Star(spark, lambda name: write_table(derive(spark, folder, name), name, "zstd"))
    return _STARS[identity]


DAMAGED = 997  # in the export, every row whose key is a multiple of this has an amount that is no number


def damaged_export(star: Star) -> tuple[str, str]:
    """Write the fact table as CSV with some lines that do not fit it; gives that folder, and one to load it to."""
    source = new_table_path(star.spark, "fact-csv")
    amount = F.when(F.col("transaction_key") % DAMAGED == 0, "n/a").otherwise(F.col("amount_usd").cast("string"))
    written = star.fact.withColumn("amount_usd", amount).write
    written.option("lineSep", "\r\n").option("nullValue", NULL_FIELD).csv(source, header=True)
    return source, f"{new_table_path(star.spark, 'fact-loaded')}/fact_transactions"  # rejected lines go beside it
