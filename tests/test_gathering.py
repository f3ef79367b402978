"""Reports from what two passes gathered: the same rows and columns, facts read twice."""

from __future__ import annotations

import random

import pytest

from shelflight import REPORTS, Star, read_star, record_report, refresh_reports, write_star
from shelflight.plans import replenishment, stock_health
from shelflight.plans.gathering import gather
from tests.conftest import days


@pytest.fixture(scope="module")
def star(spark, star_of, tmp_path_factory):
    """Months, NULL sales and seasons, a store-product without prices, prices without stock."""
    draw = random.Random(5)
    rows = []
    for store, region in (("S1", "North"), ("S1", "South"), ("S2", "North")):
        for product in ("P1", "P2", "P3", "P4"):
            pairs = [(draw.randrange(20, 90), draw.choice([None, *range(40)])) for _ in range(75)]
            rows += days(
                pairs,
                store_id=store,
                region=region,
                product_id=product,
                category=None if product == "P4" else "Toys" if product == "P1" else "Food",
                seasonality="Winter" if product == "P3" else "Summer",
                price=f"{draw.randrange(5, 30)}.{draw.randrange(10, 99)}",
                demand_forecast=f"{draw.randrange(0, 50)}.25",
            )
    rows += days([(7, None), (8, None)], product_id="P5", store_id="S3")
    full = star_of(rows)
    tables = {name: full.table(name) for name in ("stores", "products", "seasonality", "store_events")}
    partial = Star(
        **tables,
        inventory=full.inventory.where("product_id != 'P2' or day(record_date) < 20"),
        pricing=full.pricing.where("product_id != 'P3' or day(record_date) > 9").where(
            "product_id != 'P5'"
        ),
    )
    folder = str(tmp_path_factory.mktemp("star") / "star")
    write_star(partial, folder)
    return read_star(spark, folder)


@pytest.fixture(scope="module")
def ready(star):
    return gather(star)


def lines(rows):
    return sorted(map(repr, rows.collect()))


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_rows_and_columns_stay(star, ready, name):
    plain, shared = REPORTS[name].rows(star), REPORTS[name].rows(ready)
    assert shared.dtypes == plain.dtypes
    assert lines(shared) == lines(plain)
    assert plain.count() > 0


def test_other_options_are_computed_from_the_records(star, ready):
    for sigma in (0.4, 1.0):
        options = {"sigma": sigma, "fast_percent": 1}
        assert lines(replenishment.low_records(ready, **options)) == lines(
            replenishment.low_records(star, **options)
        )
    assert lines(stock_health.movement(ready, sigma=0.2)) == lines(
        stock_health.movement(star, sigma=0.2)
    )


def scans(spark, since=0):
    """Leaves of the executed plans that read files, as text."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions = store.executionsList()
    found = []
    for at in range(executions.size()):
        number = executions.apply(at).executionId()
        if number < since:
            continue
        nodes = store.planGraph(number).allNodes()
        found += [nodes.apply(i).desc() for i in range(nodes.size())]
    last = max([executions.apply(at).executionId() for at in range(executions.size())], default=-1)
    return [text for text in found if "FileScan" in text], last + 1


def reads(spark, run, table):
    _, since = scans(spark)
    run()
    found, _ = scans(spark, since)
    return sum(f"/star/{table}]" in text for text in found)


def test_a_refresh_reads_each_fact_as_often_as_it_says(spark, star, tmp_path):
    folder = str(tmp_path / "reports")

    def grouped():
        refresh_reports(star, folder, records=False)

    assert reads(spark, grouped, "inventory") == 2
    assert reads(spark, grouped, "pricing") == 1
    assert reads(spark, lambda: refresh_reports(star, folder), "inventory") == 5
    # The counting itself: a report alone reads the inventory twice.
    assert reads(spark, lambda: refresh_reports(star, folder, ["movement"]), "inventory") == 2
    for name, report in REPORTS.items():
        stored = spark.read.parquet(f"{folder}/{name}")
        assert lines(stored.select(*report.rows(star).columns)) == lines(report.rows(star)), name


def test_record_reports_follow_the_last_refresh(spark, star, tmp_path):
    folder = str(tmp_path / "reports")
    refresh_reports(star, folder, records=False)
    assert not (tmp_path / "reports" / "stock_level").exists()
    for name in ("stock_level", "low_inventory", "overstock"):
        assert lines(record_report(star, folder, name)) == lines(REPORTS[name].rows(star))
        part = record_report(star, folder, name, product_id="P1")
        assert lines(part) == lines(REPORTS[name].rows(star).where("product_id = 'P1'"))
    with pytest.raises(ValueError, match="lists no records"):
        record_report(star, folder, "movement")


def test_empty_facts_give_empty_reports(star):
    bare = Star(
        **{name: star.table(name) for name in ("stores", "products", "seasonality")},
        inventory=star.inventory.where("false"),
        pricing=star.pricing,
    )
    ready = gather(bare)
    for name in ("movement", "turnover", "regional_summary", "monthly_trend", "low_inventory_rollup"):
        assert REPORTS[name].rows(ready).count() == 0, name
