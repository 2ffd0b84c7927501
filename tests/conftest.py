from __future__ import annotations

import datetime
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.star import Star  # noqa: E402
from stars import date_row, frame_of  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_folder():
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("test data not present")
    return str(folder)


@pytest.fixture
def mini(spark):
    """Build a star from a few rows; dimensions not given hold one row with key 1."""

    def build(facts: list[dict], **tables: list[dict]) -> Star:
        days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(366)]
        given = {
            "dim_customer": [{"customer_key": 1, "customer_id": "C1", "full_name": "One"}],
            "dim_account": [{"account_key": 1, "account_id": "A1"}],
            "dim_merchant": [{"merchant_key": 1}],
            "dim_location": [{"location_key": 1}],
            "dim_date": [date_row(day) for day in days],
            **tables,
            "fact_transactions": facts,
        }
        return Star.from_frames(spark, **{name: frame_of(spark, name, rows) for name, rows in given.items()})

    return build
