"""The measures reported per group, built from parts that can be added up twice.

A measure such as the average amount is not itself additive, but its parts (a
sum and a count) are. `parts_of_rows` aggregates fact rows into parts, at the
grain of a foreign key; `parts_of_parts` adds parts up to the reported group
after the dimension has been joined. `finish` turns parts into measures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exact


@dataclass(frozen=True)
class Part:
    of_rows: Callable[[], Column]
    of_parts: Callable[[Column], Column]


PARTS: dict[str, Part] = {
    "p_rows": Part(lambda: F.count(F.lit(1)), F.sum),
    "p_amounts": Part(lambda: F.count("amount_usd"), F.sum),
    "p_units": Part(lambda: exact.value_sums(F.col("row_cents"))[0], F.sum),
    "p_cents": Part(lambda: exact.value_sums(F.col("row_cents"))[1], F.sum),
    "p_square_low": Part(lambda: exact.square_sums()[0], F.sum),
    "p_square_middle": Part(lambda: exact.square_sums()[1], F.sum),
    "p_square_high": Part(lambda: exact.square_sums()[2], F.sum),
    "p_square_large": Part(lambda: exact.square_sums()[3], F.sum),
    "p_least": Part(lambda: F.min("amount_usd"), F.min),
    "p_most": Part(lambda: F.max("amount_usd"), F.max),
    "p_flagged": Part(lambda: F.sum("is_flagged"), F.sum),
    "p_off_hours": Part(lambda: F.sum("is_off_hours"), F.sum),
    "p_first": Part(lambda: F.min("transaction_date"), F.min),
    "p_last": Part(lambda: F.max("transaction_date"), F.max),
}


@dataclass(frozen=True)
class Measure:
    parts: tuple[str, ...]
    build: Callable[..., Column]


VALUE = ("p_units", "p_cents")
SQUARES = ("p_square_low", "p_square_middle", "p_square_high", "p_square_large")
MOMENTS = ("p_amounts", *VALUE, *SQUARES)


def moments(amounts: Column, units: Column, cents: Column, *squares: Column) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares of amounts in hundredths, from the parts named in MOMENTS."""
    return amounts, exact.total_hundredths(units, cents), exact.total_squares(*squares)


def _same(column: Column) -> Column:
    return column


def _amount(column: Column) -> Column:
    return column.cast("double")


def _value(units: Column, cents: Column) -> Column:
    return exact.total_hundredths(units, cents).cast("double") / F.lit(100.0)


def _average(amounts: Column, units: Column, cents: Column) -> Column:
    return exact.mean_hundredths(exact.total_hundredths(units, cents), amounts) / F.lit(100.0)


def _deviation(*parts: Column) -> Column:
    return exact.deviation_hundredths(*moments(*parts)) / F.lit(100.0)


MEASURES: dict[str, Measure] = {
    "total_transactions": Measure(("p_rows",), _same),
    "total_value_usd": Measure(VALUE, _value),
    "average_amount_usd": Measure(("p_amounts", *VALUE), _average),
    "min_transaction_usd": Measure(("p_least",), _amount),
    "max_transaction_usd": Measure(("p_most",), _amount),
    "spend_volatility": Measure(MOMENTS, _deviation),
    "flagged_count": Measure(("p_flagged",), _same),
    "flagged_percentage": Measure(("p_flagged", "p_rows"), exact.percent),
    "off_hours_count": Measure(("p_off_hours",), _same),
    "off_hours_percentage": Measure(("p_off_hours", "p_rows"), exact.percent),
    "first_transaction": Measure(("p_first",), _same),
    "last_transaction": Measure(("p_last",), _same),
}


def _parts_needed(names: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(part for name in names for part in MEASURES[name].parts))


def parts_of_rows(names: tuple[str, ...]) -> list[Column]:
    """Aggregates over fact rows that went through `exact.with_cents`."""
    return [PARTS[part].of_rows().alias(part) for part in _parts_needed(names)]


def parts_of_parts(names: tuple[str, ...]) -> list[Column]:
    return [PARTS[part].of_parts(F.col(part)).alias(part) for part in _parts_needed(names)]


def finish(grouped: DataFrame, keys: list[str], names: tuple[str, ...], others: list[str]) -> DataFrame:
    """Replace the parts of an aggregated frame by the measures asked for."""
    built = [MEASURES[name].build(*map(F.col, MEASURES[name].parts)).alias(name) for name in names]
    return grouped.select(*keys, *others, *built)
