"""Sketches of loads: united ones estimate the whole within their bounds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelflight.operators import estimates
from shelflight.schemas import TABLES
from shelflight.storage import settle
from tests.conftest import DAY


@pytest.fixture(scope="module")
def loads(spark):
    """Three loads; one store-product has a third of all records, one has no known sales."""

    def load(first, rows):
        hot, none = "id % 3 = 0", "id % 3 = 1 and id % 50 = 7"
        return spark.range(first, first + rows, 1, 4).selectExpr(
            f"date_add(date'{DAY}', cast(id as int)) as record_date",
            f"case when {hot} then 'S1_North' else concat('S', id % 4, if(id % 8 < 4, '_North', '_South')) end as store_region_id",
            f"case when {hot} then 'hot' when {none} then 'none' else concat('P', id % 7001) end as product_id",
            "cast(id % 91 as int) as inventory_level",
            f"cast(if(({none}) or id % 11 = 3, null, pmod(id * 7919, 100003)) as int) as units_sold",
            "cast(1 as int) as units_ordered", "cast(1 as decimal(10,2)) as demand_forecast",
        ).to(TABLES["inventory"])

    parts = [load(0, 60_000), load(60_000, 20_000), load(80_000, 5)]
    return [settle(part, "load") for part in parts]


@pytest.fixture(scope="module")
def whole(loads):
    return loads[0].unionByName(loads[1]).unionByName(loads[2])


def united(parts):
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def test_medians_of_united_sketches(loads, whole):
    sketches = united([settle(estimates.median_sketches(load), "sketches") for load in loads])
    found = settle(estimates.estimated_medians(estimates.united_medians(sketches)), "medians")
    checked = estimates.medians_checked(found, whole)
    assert checked.count() == whole.select("store_region_id", "product_id").distinct().count()
    assert checked.where("not within_bound or within_bound is null").count() == 0
    hot = found.where("product_id = 'hot'").first()
    assert hot.known == whole.where("product_id = 'hot' and units_sold is not null").count() > 20_000
    none = found.where("product_id = 'none'").collect()
    assert none and all(r.known == 0 and r.median_estimate is None for r in none)


def test_the_check_finds_a_wrong_median(loads, whole):
    found = estimates.estimated_medians(estimates.median_sketches(whole))
    wrong = settle(found.withColumn("median_estimate", F.lit(-1).cast("long")), "wrong")
    checked = estimates.medians_checked(wrong, whole)
    assert checked.where("product_id = 'hot' and within_bound").count() == 0


def test_a_sketch_is_bounded_and_small_groups_are_exact(whole):
    sketches = estimates.median_sketches(whole)
    # About three times MEDIAN_K values of eight bytes, however many there are.
    assert sketches.select(F.max(F.length("sketch"))).first()[0] < 32 * estimates.MEDIAN_K
    small = estimates.estimated_medians(sketches).where("known > 0 and known < 200")
    middle = F.expr("percentile_disc(0.5) within group (order by units_sold)")
    exact = whole.groupBy("store_region_id", "product_id").agg(middle.alias("exact"))
    assert small.join(exact, ["store_region_id", "product_id"]).where("exact <> median_estimate").count() == 0


def test_products_of_united_sketches(spark, loads, whole):
    places = whole.select("store_region_id").distinct()
    stores = places.selectExpr(
        "store_region_id", "split_part(store_region_id, '_', 1) as store_id",
        "split_part(store_region_id, '_', 2) as region",
    )
    sketches = united([settle(estimates.product_sketches(load, stores), "sketches") for load in loads])
    found = estimates.estimated_products(estimates.united_products(sketches))
    checked = estimates.products_checked(found, whole, stores).collect()
    assert {r.region for r in checked} == {"North", "South"} and all(r.within_bound for r in checked)
    assert max(r.distinct_products for r in checked) > 3_000
    doubled = found.withColumn("products_estimate", F.col("products_estimate") * 2)
    assert not any(r.within_bound for r in estimates.products_checked(doubled, whole, stores).collect())


def test_empty(spark):
    nothing = spark.createDataFrame([], TABLES["inventory"])
    assert estimates.estimated_medians(estimates.median_sketches(nothing)).count() == 0
