"""Exact arithmetic for ratios, averages and deviations.

Amounts are summed as whole numbers and every rounded figure is computed from
whole numbers, so that a result does not depend on the order in which partitions are
added up and ties round half away from zero. Rounded figures are returned as
doubles. A zero or missing denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"
SQUARABLE = 1 << 31  # hundredths; the square of anything smaller fits a BIGINT
SLICE_BITS = 21


def hundredths(amount: Column) -> Column:
    """An amount with two decimals as a whole number of hundredths."""
    return (amount * 100).cast("bigint")


def with_cents(rows: DataFrame) -> DataFrame:
    """Add `row_cents`, the amount in hundredths, and `row_square`, its square where that fits a BIGINT."""
    cents = F.col("row_cents")
    return rows.withColumn("row_cents", hundredths(F.col("amount_usd"))).withColumn(
        "row_square", F.when(F.abs(cents) < SQUARABLE, cents * cents)
    )


def value_sums(cents: Column) -> tuple[Column, Column]:
    """Whole units and left-over hundredths, summed apart.

    Both are BIGINT sums, several times cheaper than a decimal sum, and far
    from overflow at any row count.
    """
    return F.sum(F.call_function("div", cents, F.lit(100))), F.sum(cents % 100)


def total_hundredths(units: Column, rest: Column) -> Column:
    """The total of `value_sums` in hundredths; wider than BIGINT."""
    return (units.cast(WHOLE) * 100 + rest).cast(WHOLE)


def square_sums() -> tuple[Column, Column, Column, Column]:
    """The squares of rows `with_cents`, summed in three slices of 21 bits, and the large ones apart.

    A slice sum is a BIGINT that holds for trillions of rows. Only amounts
    whose square does not fit a BIGINT are squared and summed as decimals.
    """
    cents, square = F.col("row_cents"), F.col("row_square")
    wide = cents.cast("decimal(19,0)")
    one_slice = F.lit((1 << SLICE_BITS) - 1)
    return (
        F.sum(square.bitwiseAND(one_slice)),
        F.sum(F.shiftright(square, SLICE_BITS).bitwiseAND(one_slice)),
        F.sum(F.shiftright(square, 2 * SLICE_BITS)),
        F.sum(F.when(square.isNull(), (wide * wide).cast(WHOLE))),
    )


def total_squares(low: Column, middle: Column, high: Column, large: Column) -> Column:
    """The total of `square_sums`, in squared hundredths."""
    slices = [
        (F.coalesce(part, F.lit(0)).cast(WHOLE) * F.lit(1 << shift).cast(WHOLE)).cast(WHOLE)
        for part, shift in ((low, 0), (middle, SLICE_BITS), (high, 2 * SLICE_BITS))
    ]
    return (slices[0] + slices[1] + slices[2] + F.coalesce(large, F.lit(0).cast(WHOLE))).cast(WHOLE)


def whole_division(numerator: Column, denominator: Column) -> Column:
    """Division of whole numbers, cut towards zero; NULL for a zero denominator."""
    return F.call_function("div", numerator.cast(WHOLE), F.nullif(denominator.cast(WHOLE), F.lit(0).cast(WHOLE)))


def round_ratio(numerator: Column, denominator: Column, scale: int = 1) -> Column:
    """`numerator * scale / denominator` as the nearest whole number, halves away from zero."""
    top = numerator.cast(WHOLE) * (2 * scale)
    bottom = denominator.cast(WHOLE)
    size = whole_division(F.abs(top) + F.abs(bottom), F.abs(bottom) * 2)
    return F.when(F.signum(top) * F.signum(bottom) < 0, -size).otherwise(size)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """`part / whole * 100` rounded to `digits` decimals."""
    return round_ratio(part, whole, 100 * 10**digits) / F.lit(float(10**digits))


def ratio(numerator: Column, denominator: Column) -> Column:
    """`numerator / denominator` rounded to two decimals."""
    return round_ratio(numerator, denominator, 100) / F.lit(100.0)


def mean_hundredths(total: Column, count: Column) -> Column:
    """The average of `count` values adding up to `total` hundredths, to the nearest hundredth."""
    return round_ratio(total, count)


def spread(count: Column, total: Column, squares: Column) -> Column:
    """`n * sum(x^2) - sum(x)^2`, the population variance times n^2, for whole x.

    Nine times this and n * sum(x^2) must have at most 38 digits, else Spark
    raises NUMERIC_VALUE_OUT_OF_RANGE: with x in hundredths, that holds while
    a group's rows times its root mean square amount stay below 3e16 units
    (300 billion rows of 100,000 units).
    """
    total = total.cast(WHOLE)
    return (count.cast(WHOLE) * squares.cast(WHOLE)).cast(WHOLE) - (total * total).cast(WHOLE)


def deviation_hundredths(count: Column, total: Column, squares: Column) -> Column:
    """The population deviation of values in hundredths, to the nearest hundredth."""
    size = F.nullif(count, F.lit(0)).cast("double")
    return F.floor(F.sqrt(spread(count, total, squares).cast("double")) / size + 0.5).cast("bigint")


def ceil_division(numerator: Column, denominator: Column) -> Column:
    """The smallest whole number not below `numerator / denominator`, for a positive denominator."""
    numerator, denominator = numerator.cast(WHOLE), denominator.cast(WHOLE)
    return whole_division(F.when(numerator > 0, numerator + denominator - 1).otherwise(numerator), denominator)


def with_ceil_sqrt(frame: DataFrame, value: str, name: str) -> DataFrame:
    """Add the smallest whole number whose square is not below `value`, a whole number from 0."""
    square = F.col(value).cast(WHOLE)

    def reaches(candidate: Column) -> Column:
        return (candidate * candidate).cast(WHOLE) >= square

    guess, root = F.col("_guess"), F.col("_root")
    step = F.coalesce(whole_division(square - (guess * guess).cast(WHOLE), guess * 2), F.lit(0))
    below = F.greatest(root - 1, F.lit(0)).cast(WHOLE)
    # One Newton step takes the double estimate to within one of the root.
    return (
        frame.withColumn("_guess", F.floor(F.sqrt(square.cast("double"))).cast(WHOLE))
        .withColumn("_root", (guess + step).cast(WHOLE))
        .withColumn(
            name, F.when(reaches(below), below).when(reaches(root), root).otherwise((root + 1).cast(WHOLE))
        )
        .drop("_guess", "_root")
    )


def with_outlier_limit(
    frame: DataFrame, count: Column, total: Column, squares: Column, name: str, deviations: int = 3
) -> DataFrame:
    """Add the smallest whole x with `x >= mean + deviations * population deviation`, decided exactly."""
    reach = (spread(count, total, squares) * (deviations * deviations)).cast(WHOLE)
    rooted = with_ceil_sqrt(frame.withColumn("_square", reach), "_square", "_reach")
    limit = ceil_division(total.cast(WHOLE) + F.col("_reach"), count)
    return rooted.withColumn(name, limit.cast("bigint")).drop("_square", "_reach")


def epoch_micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone."""
    since = moment - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # Parts of an interval carry its sign and need no wide decimals.
    days, hours, minutes, seconds = (F.extract(F.lit(part), since) for part in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = (days.cast("bigint") * 24 + hours) * 60 + minutes
    return whole * 60000000 + (seconds * 1000000).cast("bigint")
