"""The star schema a job runs on: six DataFrames behind one object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import Tables
from ledgerlens.sources.schema import SCHEMAS


class Star:
    """Six tables, each opened on first use and kept for the life of the object.

    `open_table` maps a table name to its DataFrame. `shared` keeps tables that
    several jobs read (the customer scores), so that they are computed once.
    Tables written for either belong to the star, whichever job needed them
    first, and last until `close`; a star can be used in a `with` statement.
    """

    def __init__(self, spark: SparkSession, open_table: Callable[[str], DataFrame]):
        self.spark = spark
        self._open = open_table
        self._tables: dict[str, DataFrame] = {}
        self._shared: dict[str, DataFrame] = {}
        self._written = Tables(spark)

    def close(self) -> None:
        """Drop the tables that were written for this star; what reads them cannot be used afterwards."""
        self._tables.clear()
        self._shared.clear()
        self._written.drop()

    def __enter__(self) -> Star:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def table(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(f"{name} is not a star-schema table")
        if name not in self._tables:
            with self._written.owning():
                self._tables[name] = self._open(name)
        return self._tables[name]

    def shared(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        if label not in self._shared:
            with self._written.owning():
                self._shared[label] = build()
        return self._shared[label]

    @property
    def fact(self) -> DataFrame:
        return self.table("fact_transactions")

    @property
    def customer(self) -> DataFrame:
        return self.table("dim_customer")

    @property
    def account(self) -> DataFrame:
        return self.table("dim_account")

    @property
    def merchant(self) -> DataFrame:
        return self.table("dim_merchant")

    @property
    def location(self) -> DataFrame:
        return self.table("dim_location")

    @property
    def date(self) -> DataFrame:
        return self.table("dim_date")

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Star:
        """Tables stored as `<folder>/<table>` Parquet."""
        return cls(spark, lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}"))

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> Star:
        return cls(spark, lambda name: frames[name])
