"""Whole rows beside columns of an operator's own, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def whole_row(frame: DataFrame) -> Column:
    """All columns of a frame as one, `row`, so that no other name can clash with theirs."""
    return F.struct(*(F.col(quoted(name)) for name in frame.columns)).alias("row")


def columns_of(frame: DataFrame, **instead: Column) -> list[Column]:
    """The columns of `frame`, taken out of `row` again; some of them replaced."""
    return [instead.get(name, F.col(f"row.{quoted(name)}")).alias(name) for name in frame.columns]
