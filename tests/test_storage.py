from __future__ import annotations

import os

import pytest

from shelflight import REPORTS, read_star, refresh_reports, slice_rows, write_star
from shelflight.schemas import TABLES
from shelflight.storage import bucketed_star, save_bucketed, settle, shared_folder
from tests.conftest import days, flat


@pytest.fixture(scope="module")
def star(star_of):
    return star_of(
        flat(
            days([(20 + i % 7, i % 5) for i in range(40)], product_id="P1"),
            days([(30 - i % 9, i % 4) for i in range(40)], product_id="P2", region="South"),
        )
    )


def lines(frame):
    return sorted(map(str, frame.collect()))


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_star_round_trip(spark, star, tmp_path):
    write_star(star, str(tmp_path / "star"))
    back = read_star(spark, str(tmp_path / "star"))
    for name, schema in TABLES.items():
        assert lines(back.table(name)) == lines(star.table(name))
        assert back.table(name).schema == schema


def test_missing_and_unknown_tables(star):
    from shelflight import Star

    with pytest.raises(KeyError):
        Star(stores=star.stores).pricing  # noqa: B018
    with pytest.raises(ValueError):
        Star(events=star.stores)


def test_filters_and_columns_reach_the_scan(spark, star, tmp_path):
    write_star(star, str(tmp_path / "star"))
    back = read_star(spark, str(tmp_path / "star"))
    plan = plan_of(slice_rows(REPORTS["movement"].rows(back), store_region_id="S1_South"))
    assert "EqualTo(store_region_id,S1_South)" in plan
    assert "demand_forecast" not in plan
    assert "record_date" not in plan


def test_bucketed_tables_need_no_shuffle_per_store_product(spark, star):
    save_bucketed(star, "layout_", 4)
    stored = bucketed_star(spark, "layout_")
    report = REPORTS["movement"]
    assert lines(report.rows(stored)) == lines(report.rows(star))
    sales = REPORTS["sales_profile"]
    assert lines(sales.rows(stored)) == lines(sales.rows(star))
    assert "Exchange" not in plan_of(sales.rows(stored))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = ["store_region_id", "product_id", "record_date"]
        joined = stored.inventory.join(stored.pricing, facts)
        assert "Exchange" not in plan_of(joined)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_table_lies_in_the_shared_folder(spark, star):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    table = settle(star.products, "products")
    assert lines(table) == lines(star.products)
    assert table.inputFiles()[0].removeprefix("file://").startswith(named)


def test_reports_are_written_by_store_region(spark, star, tmp_path):
    folder = str(tmp_path / "reports")
    refresh_reports(star, folder, ["movement", "category_summary"])
    assert sorted(n for n in os.listdir(f"{folder}/movement") if "=" in n) == [
        "store_region_id=S1_North",
        "store_region_id=S1_South",
    ]
    written = spark.read.parquet(f"{folder}/movement")
    assert written.count() == REPORTS["movement"].rows(star).count()
    south = slice_rows(written, product_id="P2", store_region_id="S1_South")
    assert [r.product_id for r in south.collect()] == ["P2"]
    assert slice_rows(written, product_id="P1", store_region_id="S1_South").count() == 0
    assert spark.read.parquet(f"{folder}/category_summary").count() == 1
