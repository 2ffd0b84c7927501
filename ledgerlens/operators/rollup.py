"""Grouped measures over the fact table, with and without a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exact import with_cents
from ledgerlens.functions.measures import finish, parts_of_parts, parts_of_rows


def summarise(rows: DataFrame, keys: list[str], names: tuple[str, ...], extra: dict[str, Column] | None = None) -> DataFrame:
    """Measures of fact rows per group; `extra` adds named aggregates such as distinct counts."""
    extra = extra or {}
    grouped = with_cents(rows).groupBy(*keys).agg(
        *parts_of_rows(names), *[column.alias(name) for name, column in extra.items()]
    )
    return finish(grouped, keys, names, list(extra))


def summarise_parts(
    parts: DataFrame, keys: list[str], names: tuple[str, ...], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Measures per group of rows that already hold parts."""
    extra = extra or {}
    grouped = parts.groupBy(*keys).agg(
        *parts_of_parts(names), *[column.alias(name) for name, column in extra.items()]
    )
    return finish(grouped, keys, names, list(extra))


def key_parts(rows: DataFrame, grain: list[str], names: tuple[str, ...]) -> DataFrame:
    """Parts at the grain of one or more fact columns.

    Aggregating on narrow keys first means that dimensions join a few rows per
    key instead of every transaction: a key that holds a third of the rows
    collapses inside the map tasks, before any shuffle.
    """
    return with_cents(rows).groupBy(*grain).agg(*parts_of_rows(names))


def representatives(dimension: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tables from each key to one key that stands for all with equal columns, and from that key to the columns.

    Two hashes stand for the columns, NULLs included, so that distinct counts
    shuffle a number in place of texts.
    """
    hashed = dimension.select(key, F.xxhash64(*columns).alias("_one"), F.xxhash64(F.lit(1), *columns).alias("_other"), *columns)
    first = hashed.groupBy("_one", "_other").agg(F.min(key).alias("_same"))
    named = hashed.join(first, ["_one", "_other"])
    return named.select(key, "_same"), named.filter(F.col(key) == F.col("_same")).select("_same", *columns)


def summarise_by_dimension(
    rows: DataFrame,
    dimension: DataFrame,
    key: str,
    keys: list[str],
    names: tuple[str, ...],
    extra: dict[str, Column] | None = None,
    also_by: tuple[str, ...] = (),
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """Measures per group of dimension columns, aggregated on the foreign key before the join.

    Rows whose key is missing or unknown drop out, as in an inner join. Columns
    of the fact that `extra` or `keys` use are named in `also_by`. `distinct`
    names counts of distinct values of a fact column, by groups of dimension
    columns only: they are counted per representative key, and the texts of
    the dimension join the finished groups.
    """
    if not distinct:
        parts = key_parts(rows, [key, *also_by], names)
        return summarise_parts(parts.join(dimension, key), keys, names, extra)
    same, texts = representatives(dimension, key, keys)
    parts = key_parts(rows, [key, *distinct.values()], names)
    counts = {name: F.countDistinct(column) for name, column in distinct.items()}
    groups = summarise_parts(parts.join(same, key), ["_same"], names, counts)
    return groups.join(texts, "_same").select(*keys, *counts, *names)
