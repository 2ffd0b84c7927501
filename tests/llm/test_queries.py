"""Registered queries against their SQL, and that all of them are there."""

from __future__ import annotations

import compare
import pytest

from ledgerlens.llm.queries import QUERIES, SQL

compare.SPARK_TO_DUCK["boolean"] = "BOOLEAN"


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_a_query_equals_its_sql(spark, small_folder, name):
    assert compare.differences(QUERIES[name](spark, small_folder), compare.connect(small_folder), SQL[name]) == []
