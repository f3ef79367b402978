from __future__ import annotations

import pytest

from shelflight import Star
from shelflight.operators import normalize, quality


def by(frame, key):
    return {row[key]: row.asDict() for row in frame.collect()}


def test_duplicate_keys_of_what_is_offered(staging_of):
    rows = staging_of(
        [
            {"category": "Toys"},
            {"category": "Food"},
            {"category": "Food"},
            {"product_id": "P2"},
            {"product_id": None},
        ]
    )
    report = by(quality.duplicate_keys(rows), "table_name")
    products = report["products"]
    assert products["rows_offered"] == 4
    assert products["distinct_keys"] == 2
    assert (products["duplicated_keys"], products["surplus_rows"]) == (1, 1)
    assert products["null_key_rows"] == 1
    inventory = report["inventory"]
    assert (inventory["rows_offered"], inventory["surplus_rows"]) == (5, 2)


def test_empty_table_reports_zero(staging_of):
    report = by(quality.duplicate_keys(staging_of([{}]).where("false")), "table_name")
    assert report["stores"]["rows_offered"] == 0
    assert report["stores"]["surplus_rows"] == 0


def test_orphans_are_found(staging_of):
    full = normalize.star(staging_of([{}, {"product_id": "P2"}, {"store_id": "S2"}]))
    star = Star(
        stores=full.stores.where("store_region_id = 'S1_North'"),
        products=full.products.where("product_id = 'P1'"),
        seasonality=full.seasonality,
        inventory=full.inventory,
        pricing=full.pricing,
        store_events=full.store_events,
    )
    found = {
        (r.child_table, r.parent_table): (r.rows_checked, r.orphan_keys, r.orphan_rows)
        for r in quality.orphans(star).collect()
    }
    assert found == {
        ("inventory", "stores"): (3, 1, 1),
        ("inventory", "products"): (3, 1, 1),
        ("pricing", "stores"): (3, 1, 1),
        ("pricing", "products"): (3, 1, 1),
        ("store_events", "stores"): (2, 1, 1),
        ("seasonality", "products"): (2, 1, 1),
    }


def test_domain_counts_long_values(staging_of):
    rows = staging_of([{"product_id": "P" * 11}, {"price": "12345678.90"}, {"category": None}])
    report = by(quality.domain(rows), "column_name")
    assert report["product_id"]["longest_value"] == 11
    assert report["product_id"]["rows_over_limit"] == 1
    assert report["price"] == {
        "column_name": "price",
        "declared_limit": 8,
        "longest_value": 8,
        "rows_over_limit": 0,
    }
    assert report["category"]["rows_over_limit"] == 0


def test_require_unique(staging_of):
    good = staging_of([{}, {"product_id": "P2"}])
    assert quality.require_unique(good, "inventory") is good
    with pytest.raises(quality.KeyViolation):
        quality.require_unique(staging_of([{}, {}]), "inventory")
    with pytest.raises(quality.KeyViolation, match="1 rows with a NULL key"):
        quality.require_unique(staging_of([{"record_date": None}]), "inventory")
