"""Comparing texts by a collation, on request."""

from __future__ import annotations

import pytest

from ledgerlens.plans import anomalies, customers

LOOSE = "UNICODE_CI_AI"


@pytest.fixture
def star(mini):
    """Four customers at home, but for case and accents; the fifth is abroad."""
    homes = ["Cote", "C\u00f4te", "COTE", "c\u00f4te", "Elsewhere"]
    return mini(
        [{"customer_key": i, "location_key": i % 2 + 1, "channel": "WEB", "is_flagged": 1} for i in range(5)],
        dim_customer=[
            {"customer_key": i, "customer_id": f"C{i}", "full_name": "N", "country": home, "preferred_channel": "web", "kyc_status": "UNVERIFIED"}
            for i, home in enumerate(homes)
        ],
        dim_location=[
            {"location_key": 1, "country": "c\u00f4te", "is_high_risk_country": 1},
            {"location_key": 2, "country": "Cote", "is_high_risk_country": 1},
        ],
    )


def test_countries(star):
    assert anomalies.geo_mismatch_transactions(star).count() == 5
    assert [r["customer_id"] for r in anomalies.geo_mismatch_transactions(star, collation=LOOSE).collect()] == ["C4"]
    assert [r["customer_id"] for r in anomalies.geo_mismatch_by_customer(star, collation=LOOSE).collect()] == ["C4"]
    assert anomalies.geo_mismatch_total(star).first()[0] == 5
    assert anomalies.geo_mismatch_total(star, collation=LOOSE).first()[0] == 1
    assert anomalies.geo_mismatch_total(star, collation="UNICODE_CI").first()[0] > 1  # accents count


def test_countries_that_differ_by_case_count_once(mini):
    star = mini(
        [{"customer_key": 1, "location_key": i} for i in (1, 2, 3)],
        dim_customer=[{"customer_key": 1, "country": "Home"}],
        dim_location=[{"location_key": i, "country": c} for i, c in ((1, "Away"), (2, "AWAY"), (3, "Other"))],
    )
    assert [r["countries_transacted_in"] for r in anomalies.geo_mismatch_by_customer(star).collect()] == [3]
    assert [r["countries_transacted_in"] for r in anomalies.geo_mismatch_by_customer(star, collation=LOOSE).collect()] == [2]


def test_channels(star):
    assert customers.unusual_channel_use(star).count() == 5
    assert customers.unusual_channel_use(star, collation=LOOSE).count() == 0


def test_watchlist(star):
    plain = {r["customer_id"]: (r["geo_mismatch_count"], r["poor_kyc"]) for r in customers.customer_watchlist(star).collect()}
    loose = {r["customer_id"]: (r["geo_mismatch_count"], r["poor_kyc"]) for r in customers.customer_watchlist(star, collation=LOOSE).collect()}
    assert set(plain.values()) == {(1, "NO")}
    assert loose == {**{f"C{i}": (0, "YES") for i in range(4)}, "C4": (1, "YES")}
