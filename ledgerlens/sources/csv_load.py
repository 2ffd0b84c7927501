"""Loading a table from CSV: whole records, typed and trimmed, with malformed ones kept apart.

A text reader splits the files at line ends, wherever these stand. A line that leaves a
quoted field open goes on in the next one; which lines do is known only
from the start of the file on. So each line is taken for a function of whether
it starts inside a field: it keeps that, turns it over, or ends outside or
inside whatever was before. Such functions are put together per split of a file
and then over the splits, so that no task reads more of a file than a split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.session import temporary_tables, write_table
from ledgerlens.sources.schema import SCHEMAS
from ledgerlens.sources.star import Star

BAD_LINE = "bad_line"
NULL_FIELD = "\\N"
MOST_LINES = 1000  # of one record; a quoted field that is longer is a quote gone astray
# What a quoted field can hold: quotes that are doubled, escaped, or neither before a comma nor at the end.
_INSIDE = r'[^"\\]*+(?:(?:\\(?:.|\z)|""|"(?!,|\z))[^"\\]*+)*+'
_OPEN = rf'(?s)\A(?:(?:"{_INSIDE}"(?=,|\z)|(?!")[^,]*+),)*+"{_INSIDE}\z'
_SPLIT = ["file", "block"]


@dataclass(frozen=True)
class Load:
    """The stored table, and the lines that did not fit it (one column, as read)."""

    accepted: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """One row: lines accepted and lines rejected."""
        sides = [self.accepted.select(F.lit(1).alias("a"), F.lit(0).alias("r"))]
        sides.append(self.rejected.select(F.lit(0).alias("a"), F.lit(1).alias("r")))
        return sides[0].union(sides[1]).agg(
            F.coalesce(F.sum("a"), F.lit(0)).alias("accepted_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("rejected_rows")
        )


def _with_doubled_quotes(record: Column) -> Column:
    """Write a backslash before a quote as a second quote, and two backslashes as one."""
    doubled = F.regexp_replace(record, r'(?<!\\)((?:\\\\)*+)\\"', '$1""')
    plain = F.replace(doubled, F.lit("\\\\"), F.lit("\\"))
    return F.when(F.contains(record, F.lit("\\")), plain).otherwise(record)


def _leaves_open(line: Column) -> Column:
    """Whether a line that starts outside of any field ends inside a quoted one."""
    return F.contains(line, F.lit('"')) & F.rlike(line, F.lit(_OPEN))


def _before(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add what holds before each row of a group: `known` (0 outside, 1 inside), and without it `turns` (0 or 1).

    `outside` and `inside` of a row say where it ends from either start. Where no row before
    ends the same from both, `known` is null, and `turns` tells whether they turn over what the group starts with.
    """
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = rows.withColumn("turned", F.coalesce(F.sum(F.col("outside") * (1 - F.col("inside"))).over(earlier), F.lit(0)))
    settled = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("ends"), "turned"))
    return (
        turned.withColumn("settled", F.last(settled, ignorenulls=True).over(earlier))
        .withColumn("known", (F.col("settled.ends") + F.col("turned") - F.col("settled.turned")) % 2)
        .withColumn("turns", F.col("turned") % 2)
        .drop("settled", "turned")
    )


def _parts(lines: DataFrame, most_lines: int) -> DataFrame:
    """The lines (file, block, place) that make up records of several lines, with the place of the first: start.

    Left out are records of more than `most_lines` lines, and what is open at the end of a
    file: their lines stand for themselves, so that a stray quote takes nothing along.
    """
    opened = lines.filter("outside = 1").select("file").distinct()
    rows = _before(lines.select(*_SPLIT, "place", "outside", "inside").join(opened, "file", "left_semi"), _SPLIT, "place")
    rows = write_table(rows, "csv-line-states")
    # A split as a whole is such a function too: that of its last line, from what is before it.
    at_end = F.max_by(F.struct("known", "turns", "outside", "inside"), "place")
    ends = rows.groupBy(*_SPLIT).agg(at_end.alias("last"))

    def end_from(start: int) -> Column:
        state = F.coalesce(F.col("last.known"), (F.lit(start) + F.col("last.turns")) % 2)
        return F.when(state == 0, F.col("last.outside")).otherwise(F.col("last.inside"))

    splits = ends.select(*_SPLIT, end_from(0).alias("outside"), end_from(1).alias("inside"))
    starts = _before(splits, ["file"], "block").select(*_SPLIT, F.coalesce("known", "turns").alias("begin"))
    state = F.coalesce("known", (F.col("begin") + F.col("turns")) % 2)
    placed = (
        rows.join(starts, _SPLIT)
        .withColumn("state", state)
        .withColumn("after", F.when(state == 0, F.col("outside")).otherwise(F.col("inside")))
        .filter("state = 1 or after = 1")
        .withColumn("opener", F.when(F.col("state") == 0, F.struct("block", "place")))
        .select(*_SPLIT, "place", "after", "opener")
    )
    placed = write_table(placed, "csv-parts")
    so_far = Window.partitionBy(*_SPLIT).orderBy("place")
    splits_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy(*_SPLIT)
        .agg(F.max("opener").alias("latest"))
        .select(*_SPLIT, F.last("latest", ignorenulls=True).over(splits_before).alias("carried"))
    )
    parts = placed.join(carried, _SPLIT).withColumn(
        "start", F.coalesce(F.last("opener", ignorenulls=True).over(so_far), "carried")
    )
    records = parts.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"), F.min("after").alias("open"))
    whole = records.filter(f"open = 0 and lines <= {most_lines}")
    return parts.join(whole, ["file", "start"]).select(*_SPLIT, "place", "start")


def rejected_path(target: str) -> str:
    return f"{target.rstrip('/')}_rejected"


def load_csv_table(
    spark: SparkSession, name: str, source: str, target: str, line_end: str = "\r\n", most_lines: int = MOST_LINES
) -> Load:
    """Replace the Parquet table at `target` by the CSV files at `source`.

    Fields are separated by commas and may be quoted; a quote inside a quoted
    field is doubled or follows a backslash, and commas and line ends in it stand for themselves. `\\N` or nothing between two
    commas stands for NULL, and the first record of a file is a header. Blanks
    around texts are cut off, and empty lines between records are passed over. A record with the wrong number of fields, or a
    field that does not fit its type, goes to the folder `rejected_path` as it
    was read, byte for byte, which is replaced too. A quoted field that is not closed within `most_lines`
    lines, or in its file, is a stray quote: its lines are taken one by one.
    Lines are looked through for open fields, and read and parsed once: what was parsed is kept in a table of the session's
    shared folder, split from there, and dropped. Only the lines of records that go over several are put together and parsed again.
    """
    schema = SCHEMAS[name]
    with_line = StructType([*schema.fields, StructField(BAD_LINE, StringType())])
    # Line ends inside fields stay as they are with multiLine.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE, "nullValue": NULL_FIELD, "quote": '"',
               "escape": '"', "multiLine": "true", "lineSep": "\n"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_line)
    columns = [
        (F.trim(F.col(f"fields.{f.name}")) if isinstance(f.dataType, StringType) else F.col(f"fields.{f.name}")).alias(f.name)
        for f in schema
    ]

    def parsed(records: DataFrame) -> DataFrame:
        return records.withColumn("fields", F.from_csv(_with_doubled_quotes(F.col("line")), ddl, options))

    def replace(frame: DataFrame, path: str) -> DataFrame:
        # Dynamic overwriting would keep an old table when nothing new is written.
        frame.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    with temporary_tables(spark):
        read = spark.read.text(source, lineSep=line_end).select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),  # rises from line to line within a split
        )
        outside, inside = _leaves_open(F.col("line")), _leaves_open(F.concat(F.lit('"'), "line"))
        # Some files have a line that leaves a field open; a row per file can be broadcast. Only there, lines can belong
        # together. Elsewhere the text of a line that fits the table is not needed any more.
        opened = F.broadcast(read.filter(outside).select("file").distinct().withColumn("opened", F.lit(True)))
        good = F.col(f"fields.{BAD_LINE}").isNull()
        text = F.when(F.col("opened") | ~good | (F.col("line") == ""), F.col("line"))
        lines = write_table(
            parsed(read).join(opened, "file", "left").select(
                "file", "block", "place", "fields", text.alias("line"),
                outside.cast("int").alias("outside"), inside.cast("int").alias("inside"),
            ),
            "parsed-lines",
            "zstd",
        )
        place = [*_SPLIT, "place"]
        firsts = lines.groupBy("file").agg(F.min(F.struct("block", "place")).alias("first"))
        headers = F.broadcast(firsts.select("file", "first.*"))
        records = lines.filter("line is null or line <> ''")
        if not lines.filter("outside = 1").isEmpty():
            parts = write_table(_parts(lines, most_lines), "csv-records")
            # Empty lines inside a field belong to it.
            text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "line"))), lambda p: p["line"]), line_end)
            joined = lines.select(*place, "line").join(parts, place).groupBy("file", "start").agg(text.alias("line"))
            glued = parsed(joined.select("file", "start.*", "line"))
            records = records.join(parts, place, "left_anti").select(*place, "line", "fields").unionByName(glued)
        records = records.join(headers, place, "left_anti")
        accepted = replace(records.filter(good).select(*columns), target)
        return Load(accepted, replace(records.filter(~good).select(F.col("line").alias(BAD_LINE)), rejected_path(target)))


def load_star(spark: SparkSession, source: str, folder: str, line_end: str = "\r\n") -> tuple[Star, dict[str, Load]]:
    """Load `<source>/<table>` into `<folder>/<table>` for all six tables, and open them.

    Run `plans.audits.orphan_audit` on the star to see fact rows whose keys match nothing.
    """
    loads = {name: load_csv_table(spark, name, f"{source}/{name}", f"{folder}/{name}", line_end) for name in SCHEMAS}
    return Star.from_parquet(spark, folder), loads
