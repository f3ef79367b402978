"""Facts stored at the same bounds: no exchange, bounded ranges, the same reports."""

from __future__ import annotations

import datetime as dt
import re
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from shelflight import REPORTS
from shelflight.aligned import _numbers, aligned_star, attach, save_aligned
from shelflight.schemas import TABLES
from shelflight.star import RANGE, Star
from tests.conftest import DAY


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all records belongs to one store-product."""
    hot = "id % 3 = 0"
    rows = spark.range(0, 9_000, 1, 3).selectExpr(
        f"date_add(date'{DAY}', cast(if({hot}, id / 3, id % 40) as int)) as record_date",
        f"if({hot}, 'S1_North', concat('S', cast(id / 400 as int), '_North')) as store_region_id",
        f"if({hot}, 'P1', concat('Q', cast(id % 400 / 40 as int))) as product_id",
        "cast(id % 91 as int) as inventory_level", "cast(id % 17 as int) as units_sold",
        "cast(1 as int) as units_ordered", "cast(id % 7 as decimal(10,2)) as demand_forecast",
        "cast(id % 13 as decimal(10,2)) as price", "cast(id % 5 as decimal(5,2)) as discount",
        "cast(id % 11 as decimal(10,2)) as competitor_pricing",
    ).dropDuplicates(["record_date", "store_region_id", "product_id"])
    products = rows.select("product_id").distinct().withColumn("category", F.lit("Toys"))
    empty = {n: spark.createDataFrame([], TABLES[n]) for n in ("stores", "seasonality", "store_events")}
    return Star(
        inventory=rows.to(TABLES["inventory"]),
        # Some records have no price.
        pricing=rows.where("id is null or price <> 3" if "id" in rows.columns else "price <> 3").to(TABLES["pricing"]),
        products=products.to(TABLES["products"]),
        **empty,
    )


@pytest.fixture(scope="module")
def saved(spark, skewed, tmp_path_factory):
    prefix, folder = f"t_{uuid4().hex}_", str(tmp_path_factory.mktemp("aligned") / "star")
    return prefix, folder, save_aligned(skewed, prefix, folder, range_rows=1_500)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", ["competitor_pricing", "discount_effect"])
def test_reports_are_the_same(spark, skewed, saved, name):
    assert rows_of(REPORTS[name].rows(aligned_star(spark, saved[0]))) == rows_of(REPORTS[name].rows(skewed))


def test_no_fact_is_exchanged(spark, saved):
    star = aligned_star(spark, saved[0])
    plan = REPORTS["competitor_pricing"].rows(star)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin") :]
    # The dimension is joined above; below the join of the facts nothing is shuffled.
    facts = below[: re.search(r"\n[^\n]*t_\w*products", below).start()] if "products" in below else below
    assert "SelectedBucketsCount" in facts or "Bucketed: true" in facts
    assert "Exchange" not in facts.split("BroadcastExchange")[0]


def test_ranges_are_bounded(spark, saved):
    prefix, folder, ranges = saved
    bounds = spark.read.parquet(f"{folder}/bounds").collect()
    assert len(bounds) == ranges > 5
    sizes = [b.inventory_rows + b.pricing_rows for b in bounds]
    assert max(sizes) < 1.6 * 1_500
    # The hot store-product lies in several ranges, one after the other.
    hot = [b for b in bounds if (b.first.store_region_id, b.first.product_id) <= ("S1_North", "P1")
           <= (b.last.store_region_id, b.last.product_id)]
    assert len(hot) >= 3
    ordered = sorted(bounds, key=lambda b: tuple(b.first))
    assert all(tuple(a.last) < tuple(b.first) for a, b in zip(ordered, ordered[1:]))


def test_each_range_is_a_bucket(spark, saved):
    for name in ("inventory", "pricing"):
        table = spark.table(f"{saved[0]}{name}")
        files = table.select(RANGE, F.input_file_name().alias("file")).distinct().collect()
        assert len({r.file for r in files}) == len({r[RANGE] for r in files}) == len(files)


def test_other_sessions_attach_the_tables(spark, skewed, saved):
    star = attach(spark, f"u_{uuid4().hex}_", saved[1])
    assert rows_of(star.inventory.drop(RANGE)) == rows_of(skewed.inventory)
    assert rows_of(REPORTS["discount_effect"].rows(star)) == rows_of(REPORTS["discount_effect"].rows(skewed))


def test_numbers_fill_all_buckets(spark):
    for ranges in (1, 2, 50):
        found = _numbers(spark, ranges).selectExpr("at", f"pmod(hash({RANGE}), {ranges}) as bucket").collect()
        assert sorted(r.at for r in found) == list(range(ranges)) and all(r.at == r.bucket for r in found)
