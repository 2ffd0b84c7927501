"""The star derived from order tables: keys of any size, and line items that move once."""

from __future__ import annotations

import re

import pytest
from compare import plan_of
from pyspark.sql import functions as F

from ledgerlens.sources.order_star import _transaction_key, derive


def test_transaction_keys_of_any_size(spark):
    rows = [
        (1, 1, 1, 1), (0, 0, 0, 0), (54_000_000, 7, 7_200_000, 360_000), (1 << 38, 7, 1 << 40, 1 << 40), ((1 << 38) + 1, 7, 5, 5),
        (115_292_150, 3, 460_684, 25_807), (11_529_215, 0, 46_068, 54_775_807), (1 << 40, 1, 2, 3), (99_999_999_999, 6, 1, 9),
    ]
    frame = spark.createDataFrame([*rows, (None, 1, 1, 1), (1, 1, None, 1)], "o long, l int, p long, s long")
    found = [r[0] for r in frame.select(_transaction_key(*map(F.col, "olps"))).collect()]
    assert found == [(((o * 8 + n) * 10**6 + p) * 10**5 + s) % (2**63 - 1) for o, n, p, s in rows] + [None, None]


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_items_move_once(spark, small_folder, no_broadcasts):
    """Orders meet customers below the one join that line items take part in."""
    joins = re.findall(r"(?:SortMerge|ShuffledHash)Join \[(\w+)#", plan_of(derive(spark, small_folder, "fact_transactions")))
    assert joins[0] == "l_orderkey" and len(joins) == 2
