"""Fixed schemas of the six star-schema tables."""

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

KEY, TEXT, WHOLE, DAY = LongType(), StringType(), IntegerType(), DateType()
MONEY, MOMENT = DecimalType(18, 2), TimestampNTZType()


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


# Flags are 0 or 1 rather than booleans, since they are summed; a date key reads yyyymmdd.
SCHEMAS: dict[str, StructType] = {
    "fact_transactions": _table(
        transaction_key=KEY,
        transaction_id=TEXT,
        customer_key=KEY,
        account_key=KEY,
        merchant_key=KEY,
        location_key=KEY,
        date_key=WHOLE,
        amount_usd=MONEY,
        is_flagged=WHOLE,
        is_off_hours=WHOLE,
        channel=TEXT,
        transaction_type=TEXT,
        status=TEXT,
        transaction_hour=WHOLE,
        transaction_date=DAY,
        transaction_datetime=MOMENT,
    ),
    "dim_customer": _table(
        customer_key=KEY,
        customer_id=TEXT,
        full_name=TEXT,
        country=TEXT,
        kyc_status=TEXT,
        customer_segment=TEXT,
        preferred_channel=TEXT,
    ),
    "dim_account": _table(
        account_key=KEY, account_id=TEXT, account_type=TEXT, balance_tier=TEXT, account_status=TEXT
    ),
    "dim_merchant": _table(
        merchant_key=KEY,
        merchant_name=TEXT,
        merchant_category=TEXT,
        risk_rating=TEXT,
        country=TEXT,
        is_shell_merchant=WHOLE,
    ),
    "dim_location": _table(location_key=KEY, country=TEXT, city=TEXT, region=TEXT, is_high_risk_country=WHOLE),
    "dim_date": _table(
        date_key=WHOLE,
        full_date=DAY,
        year_number=WHOLE,
        month_number=WHOLE,
        month_name=TEXT,
        quarter_number=WHOLE,
        day_of_week=TEXT,
        is_weekend=WHOLE,
    ),
}

# The fact column that refers to each dimension.
FACT_KEYS = {
    "dim_customer": "customer_key",
    "dim_account": "account_key",
    "dim_merchant": "merchant_key",
    "dim_location": "location_key",
    "dim_date": "date_key",
}
