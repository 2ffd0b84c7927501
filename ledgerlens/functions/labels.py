"""Fixed value lists and the orderings built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CHANNELS = ["Mobile", "Web", "ATM", "Branch"]
RISK_TIERS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MINIMAL"]
POOR_KYC = ["Unverified", "Expired"]
RISKY_RATINGS = ["High", "Critical"]


def place_in(value: Column, listed: list[str]) -> Column:
    """The 1-based place of a value in a list; 0 for a missing value or one outside the list."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, listed)), value), F.lit(0)).cast("int")


def labelled(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


def compared(text: Column, collation: str | None) -> Column:
    """A text as comparisons take it: byte by byte, or by one of Spark's collations.

    UNICODE_CI_AI takes no notice of case and accents, as database servers often do.
    """
    return text if collation is None else F.collate(text, collation)
