"""Run the SQL oracle in DuckDB and compare a job with it, row for row."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sortable(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "nan")
    return (1, str(value) if isinstance(value, (datetime.date, decimal.Decimal)) else repr(value))


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda r: [_sortable(v) for v in r])


def differences(job: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    found = []
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), "?") for f in job.schema}
    duck_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    if spark_types != duck_types:
        found.append(f"types differ: {sorted(set(spark_types.items()) ^ set(duck_types.items()))}")
    ours, theirs = _rows(job.collect(), job.columns), _rows(relation.fetchall(), relation.columns)
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def global_windows(plan: str) -> int:
    """Windows that sit on an exchange into a single partition."""
    lines = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    found = 0
    for number, line in enumerate(lines):
        if line.startswith("Window ["):
            below = next(b for b in lines[number + 1 :] if not b.startswith(("Sort", "Project", "Window")))
            found += below.startswith("Exchange SinglePartition")
    return found
