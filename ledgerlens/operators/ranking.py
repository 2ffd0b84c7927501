"""Global order without a global window: top rows, quantile buckets, running shares."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 12  # of a number that one pass over the rows tells apart
_SIGN = -(1 << 63)


def top(frame: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """The first rows in a total order; planned as a per-task top-k."""
    return frame.orderBy(*order).limit(count)


def _order_value(value: Column, key: Column) -> Column:
    # Structs compare field by field with NULL first, which is the order wanted.
    return F.struct(value.cast("bigint").alias("value"), key.cast("bigint").alias("key"))


@dataclass(frozen=True)
class _Probe:
    """Rows among which a cutoff lies: those whose number begins with `prefix`, its last `open` bits left open.

    The number is the signal's value, or once that is found (`at`, which may be (None,)) the key.
    Numbers are taken as unsigned, with the sign turned over, which keeps their order.
    """

    signal: str
    at: tuple | None
    prefix: int
    open: int

    def row(self) -> tuple:
        """The value found, if any, the bits found as a signed number, how many are open, and how many of them are next."""
        prefix = self.prefix if self.prefix < -_SIGN else self.prefix + 2 * _SIGN
        return self.at is not None, self.at[0] if self.at else None, prefix, self.open, min(self.open, DIGIT_BITS)

    def at_digit(self, digit: int) -> _Probe:
        step = min(self.open, DIGIT_BITS)
        return replace(self, prefix=(self.prefix << step) | digit, open=self.open - step)

    def number(self) -> int:
        """The number, once no bit is open."""
        return self.prefix + _SIGN


def _common_prefix(least: int, most: int) -> tuple[int, int]:
    """The leading bits that all numbers from least to most share, and how many bits that leaves open."""
    low, high = least - _SIGN, most - _SIGN
    spread = (low ^ high).bit_length()
    return low >> spread, spread


def _histograms(frame: DataFrame, probes: list[_Probe], key: str) -> dict[_Probe, list[tuple[int, int]]]:
    """How many rows of each probe have which digit: one pass, of which each task returns counts only."""
    signals = list(dict.fromkeys(probe.signal for probe in probes))
    # Probes are rows rather than expressions: a filter on an array of dozens of these would be interpreted for each row.
    wanted = frame.sparkSession.createDataFrame(
        [(i, signals.index(probe.signal), *probe.row()) for i, probe in enumerate(probes)],
        "probe int, signal int, by_key boolean, at bigint, prefix bigint, open int, step int",
    )
    values = F.array(*[F.struct(F.lit(i).alias("signal"), F.col(s).cast("bigint").alias("value")) for i, s in enumerate(signals)])
    rows = frame.select(F.col(key).cast("bigint").alias("key"), F.inline(values)).join(F.broadcast(wanted), "signal")
    number = F.when(F.col("by_key"), F.col("key")).otherwise(F.col("value"))
    flipped = number.bitwiseXOR(F.lit(_SIGN))
    inside = (F.col("open") == 64) | (F.call_function("shiftrightunsigned", flipped, F.col("open")) == F.col("prefix"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("step")) - 1
    rest = F.call_function("shiftrightunsigned", flipped, F.col("open") - F.col("step")).bitwiseAND(mask).cast("int")
    same = ~F.col("by_key") | F.col("value").eqNullSafe(F.col("at"))
    # The next bits of a row's number, -1 for a missing key, or null for rows of other probes.
    digit = F.when(same, F.when(F.col("by_key") & F.col("key").isNull(), -1).otherwise(F.when(inside, rest)))
    counted = rows.select("probe", digit.alias("digit")).filter("digit is not null").groupBy("probe", "digit").count().collect()
    found: dict[_Probe, list[tuple[int, int]]] = {probe: [] for probe in probes}
    for row in sorted(counted):
        found[probes[row["probe"]]].append((row["digit"], row["count"]))
    return found


def quantile_cutoffs(frame: DataFrame, signals: list[str], key: str, buckets: int) -> dict[str, list[tuple]]:
    """The last (value, key) of every bucket but the last, per signal, as NTILE would fill them.

    Nothing is sorted or shuffled but counts. Each cutoff is the row at a known
    place, which is closed in on digit by digit: a pass counts, for all cutoffs
    at once, the rows by the next bits of their value among those that share the bits found so far; when
    the value is found, the rows that tie there are told apart by key in the
    same way. Passes start at the first bit in which values differ, and
    bits are taken twelve at a time, so shares need two passes and a billion
    keys three. The driver sees at most 4096 counts per cutoff and pass.
    """
    numbers = {signal: F.col(signal).cast("bigint") for signal in (*signals, key)}
    ranges = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.count(n).alias("known"), F.min(n).alias("least"), F.max(n).alias("most")).alias(f"range_{i}")
          for i, n in enumerate(numbers.values())],
    ).first()
    members = ranges["rows"]
    if members == 0:
        return {signal: [] for signal in signals}
    span = {signal: ranges[f"range_{i}"] for i, signal in enumerate(numbers)}

    def among_keys(signal: str, value: int | None) -> _Probe:
        bounds = span[key]
        return _Probe(signal, (value,), *(_common_prefix(bounds["least"], bounds["most"]) if bounds["known"] else (0, 0)))

    cutoffs: dict[str, list[tuple]] = {signal: [None] * (buckets - 1) for signal in signals}
    sought: list[tuple[_Probe, int, int]] = []  # a cutoff's probe, its place among the rows there, its bucket
    for signal in signals:
        missing = members - span[signal]["known"]
        for bucket in range(1, buckets):
            place = max(bucket * (members // buckets) + min(bucket, members % buckets) - 1, 0)
            if place < missing:
                sought.append((among_keys(signal, None), place, bucket))
            else:
                prefix, spread = _common_prefix(span[signal]["least"], span[signal]["most"])
                sought.append((_Probe(signal, None, prefix, spread), place - missing, bucket))
    while sought:
        # A value with no bit open is found; keys are looked at once even so, as one may be missing.
        sought = [
            (among_keys(p.signal, p.number()), place, bucket) if p.at is None and not p.open else (p, place, bucket)
            for p, place, bucket in sought
        ]
        counts = _histograms(frame, list(dict.fromkeys(p for p, _, _ in sought)), key)
        going_on = []
        for probe, place, bucket in sought:
            for digit, count in counts[probe]:
                if place < count:
                    break
                place -= count
            if digit == -1:
                cutoffs[probe.signal][bucket - 1] = (probe.at[0], None)
            elif (closer := probe.at_digit(digit)).open or closer.at is None:
                going_on.append((closer, place, bucket))
            else:
                cutoffs[probe.signal][bucket - 1] = (probe.at[0], closer.number())
        sought = going_on
    return cutoffs


def bucket_of(signal: str, key: str, cutoffs: list[tuple]) -> Column:
    """The bucket of a row: one more than the cutoffs it lies beyond."""
    place = _order_value(F.col(signal), F.col(key))
    beyond = [
        F.when(place > _order_value(F.lit(value), F.lit(last_key)), 1).otherwise(0) for value, last_key in cutoffs
    ]
    return sum(beyond, F.lit(1)).cast("int")


def with_quantiles(frame: DataFrame, scores: dict[str, str], key: str, buckets: int = 5) -> DataFrame:
    """Add a NTILE column per signal; `scores` maps signal column to score column.

    `frame` is read several times and should be a stored table.
    """
    cutoffs = quantile_cutoffs(frame, list(scores), key, buckets)
    return frame.withColumns({score: bucket_of(signal, key, cutoffs[signal]) for signal, score in scores.items()})


def running_total_by_value(frame: DataFrame, value: str, count: int, name: str) -> DataFrame:
    """The `count` largest distinct values with the sum of `value` over all rows at or above each.

    Equal values share one running total, as under a RANGE frame. Any value
    above one of the largest is itself among them, so the window runs over at
    most `count` rows.
    """
    masses = frame.groupBy(value).agg(F.sum(value).alias("mass"))
    largest = top(masses, count, F.col(value).desc_nulls_last())
    running = F.sum("mass").over(Window.orderBy(F.col(value).desc_nulls_last()))
    return largest.select(value, running.alias(name))
