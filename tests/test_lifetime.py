"""Settled copies go, failed loads leave no star, slices reach the scan that sums."""

from __future__ import annotations

import os

import pytest

from shelflight import REPORTS, load_star, prepare, read_star, refresh_reports, settled_tables, write_star
from shelflight.operators import normalize
from shelflight.operators.quality import KeyViolation
from shelflight.schemas import TABLES
from shelflight.session import RUN_SETTINGS
from shelflight.sources import sample_tables
from shelflight.storage import settle, shared_folder
from tests.conftest import days, flat
from tests.test_load import GOOD, write


@pytest.fixture(scope="module")
def star(star_of):
    return star_of(
        flat(
            days([(20 + i % 7, i % 5) for i in range(30)], product_id="P1"),
            days([(30 - i % 9, i % 4) for i in range(30)], product_id="P2", region="South"),
        )
    )


def left(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def lines(frame):
    return sorted(map(str, frame.collect()))


def test_reports_and_loads_leave_nothing_settled(spark, star, tmp_path):
    before = left(spark)
    refresh_reports(star, str(tmp_path / "reports"))
    load_star(spark, write(tmp_path, GOOD), str(tmp_path / "star"), tolerant=True)
    assert left(spark) == before


def test_scope_removes_what_it_settled(spark, star):
    before = left(spark)
    with settled_tables(spark):
        rows = settle(star.products, "products").collect()
        assert len(left(spark)) == len(before) + 1
    assert left(spark) == before and len(rows) == 2


def test_failed_load_leaves_no_star(spark, tmp_path):
    folder = str(tmp_path / "star")
    with pytest.raises(KeyViolation):
        load_star(spark, write(tmp_path, GOOD, GOOD, "bad"), folder, tolerant=True)
    assert not os.path.exists(folder)


def test_star_without_its_mark_is_refused(spark, star, tmp_path):
    folder = str(tmp_path / "star")
    write_star(star, folder)
    os.rename(f"{folder}/whole", f"{folder}/broken")
    with pytest.raises(Exception, match="(?i)path"):
        read_star(spark, folder)


def test_slice_reaches_the_sums(spark, star, tmp_path):
    write_star(star, str(tmp_path / "star"))
    stored = read_star(spark, str(tmp_path / "star"))
    sliced = stored.sliced(store_region_id="S1_South")
    whole = REPORTS["movement"].rows(stored).where("store_region_id = 'S1_South'")
    assert lines(REPORTS["movement"].rows(sliced)) == lines(whole)
    assert "EqualTo(store_region_id,S1_South)" in plan_of(sliced.inventory.groupBy("product_id").count())
    assert sliced.sliced(product_id="P1").inventory.count() == 0


def test_checked_load_projects_prices(star_of, staging_of):
    rows = staging_of(days([(5, 1), (6, 2)]))
    plain = normalize.star(rows, unique=True).pricing
    assert "Aggregate" not in plan_of(plain)
    assert lines(plain) == lines(normalize.star(rows).pricing)


def test_prepare_sets_only_what_it_names(spark):
    assert prepare(spark) is spark
    assert all(spark.conf.get(name) == value for name, value in RUN_SETTINGS.items())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="sample tables absent")
def test_sample_tables_have_declared_types(spark):
    star = sample_tables.star(spark, "/root/testdata/sf0.001")
    for name, schema in TABLES.items():
        assert star.table(name).schema == schema


def test_numbered_rows_are_in_presented_order(star):
    for name in ("movement", "stock_level", "stock_recommendations"):
        rows = REPORTS[name].numbered(star).orderBy("position").collect()
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
        shown = [str(r) for r in REPORTS[name].ordered(star).collect()]
        assert [str(r)[: str(r).rindex(", position=")] + ")" for r in rows] == shown


def test_all_null_and_partly_null_sales(star_of):
    rows = star_of(
        flat(
            days([(9, None), (9, None)], product_id="P1"),
            days([(9, None), (9, None), (9, 1), (9, 2)], product_id="P2"),
            days([(9, None), (9, 4), (9, 6)], product_id="P3"),
            days([(9, -3), (9, -5)], product_id="P4"),
            days([(9, None), (9, -7)], product_id="P5"),
        )
    )
    found = {r.product_id: r for r in REPORTS["sales_profile"].rows(rows).collect()}
    assert {p: r.median_sales for p, r in found.items()} == {
        "P1": None, "P2": 1.0, "P3": 4.0, "P4": -4.0, "P5": -7.0
    }
    assert found["P1"].avg_sales is None and found["P1"].stddev_sales is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="sample tables absent")
@pytest.mark.parametrize("name", [n for n, r in REPORTS.items() if r.reread])
def test_base_lines_are_read_once(spark, monkeypatch, name):
    """One table is settled from them; what the report runs on reads settled tables only."""
    calls = []

    def counted(table, label, by=None):
        calls.append(label)
        return settle(table, label, by)

    monkeypatch.setattr(sample_tables, "settle", counted)
    report = REPORTS[name]
    star = sample_tables.star(spark, "/root/testdata/sf0.001", report.reread, report.dims)
    assert "lineitem" not in plan_of(report.rows(star))
    assert len(calls) == 1
