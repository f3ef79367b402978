"""Relations between reports, row order, and plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelflight import REPORTS
from shelflight.plans import demand, replenishment, stock_health
from tests.conftest import days, flat


@pytest.fixture(scope="module")
def star(star_of):
    draw = random.Random(11)
    rows = []
    for store, region in (("S1", "North"), ("S1", "South"), ("S2", "North")):
        for product in ("P1", "P2", "P3"):
            pairs = [(draw.randrange(20, 90), draw.randrange(0, 40)) for _ in range(60)]
            rows += days(
                pairs,
                store_id=store,
                region=region,
                product_id=product,
                category="Toys" if product == "P1" else "Food",
                seasonality="Winter" if product == "P3" else "Summer",
                price=str(draw.randrange(5, 30)),
                demand_forecast=str(draw.randrange(0, 50)),
            )
    return star_of(rows)


@pytest.fixture(scope="module")
def rows(star):
    made = {}

    def get(name):
        if name not in made:
            made[name] = REPORTS[name].ordered(star).collect()
        return made[name]

    return get


def totals(rows, key, value):
    out = {}
    for row in rows:
        out[row[key]] = out.get(row[key], 0) + row[value]
    return out


def test_stockouts_agree_between_reports(rows):
    per_store = totals(rows("kpi_summary"), "store_region_id", "stockout_days")
    assert per_store == {r.store_region_id: r.stockout_days for r in rows("stockout_by_store")}
    flagged = {}
    for r in rows("stock_level"):
        flagged.setdefault(r.store_region_id, 0)
        flagged[r.store_region_id] += r.stock_status == "Understock"
    assert flagged == per_store


def test_percentages_agree_with_days(rows):
    for r in rows("movement"):
        assert r.understock_percentage == round(100 * r.understock_days / r.total_days, 2)


def test_category_totals_are_fact_totals(star, rows):
    total = star.inventory.agg(F.sum("units_sold"), F.sum("demand_forecast")).first()
    assert sum(r.total_units_sold for r in rows("category_summary")) == total[0]
    assert sum(r.total_forecast for r in rows("category_summary")) == total[1]


def test_regions_cover_all_records(star, rows):
    assert sum(r.total_records for r in rows("regional_summary")) == star.inventory.count()
    assert {r.region: r.distinct_products for r in rows("regional_summary")} == {
        "North": 3,
        "South": 3,
    }


def test_low_inventory_rollup_adds_up(rows):
    low = sum(r.inventory_status == "Low Inventory" for r in rows("low_inventory"))
    for dimension in ("product", "store_region"):
        part = [r for r in rows("low_inventory_rollup") if r.dimension == dimension]
        assert sum(r.low_inventory_records for r in part) == low


def test_first_month_has_no_projection(rows):
    first = [r for r in rows("seasonal_demand") if r.month_name == "January"]
    later = [r for r in rows("seasonal_demand") if r.month_name != "January"]
    assert first and all(r.trend_based_next_month_prediction is None for r in first)
    assert later and all(r.trend_based_next_month_prediction is not None for r in later)


def ranked(report, row):
    """Sort key of a row by the report's order; descending numbers are negated."""
    return tuple(-row[k[1:]] if k.startswith("-") else row[k] for k in report.order)


@pytest.mark.parametrize("name", sorted(n for n in REPORTS if not REPORTS[n].hidden))
def test_presented_order(rows, name):
    keys = [ranked(REPORTS[name], row) for row in rows(name)]
    assert keys == sorted(keys)


def test_months_are_presented_in_calendar_order(rows):
    cells = [(r.store_region_id, r.seasonality, r.category) for r in rows("seasonal_demand")]
    assert cells == sorted(cells)
    first = [r.month_name for r in rows("seasonal_demand")][:3]
    assert first == ["January", "February", "March"]


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_plans_stay_in_the_jvm_and_avoid_products(star, name):
    plan = REPORTS[name].ordered(star)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_join_strategy_does_not_change_results(spark, star, rows):
    names = ["stock_level", "low_inventory", "stock_recommendations", "competitor_pricing"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in names:
            shuffled = REPORTS[name].ordered(star)
            assert shuffled.collect() == rows(name), name
            assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_options_change_thresholds(star):
    strict = stock_health.movement(star, sigma=0.1, percent=0)
    assert {r.movement_type for r in strict.collect()} == {"Fast-selling"}
    assert stock_health.overstock(star, factor=1000).where("demand_forecast > 0").count() == 0


def test_label_and_formula_have_their_own_limits(star_of):
    # 7% of days far below: slow by label (10%), fast by formula (5%).
    pairs = [(10, 0)] * 93 + [(0, 0)] * 7
    row = replenishment.reorder_points(star_of(days(pairs))).first()
    assert (row.understock_percentage, row.movement_type) == (7.0, "Slow-moving")
    assert row.reorder_point == 9.3


def test_reorder_point_equal_to_stock_counts_as_low(star_of):
    # Mean stock 51.3 less mean sales 25.3 is 26; the doubles of the two means
    # differ by a little less, which must not turn the record of 26 sufficient.
    pairs = [(26, 0), (27, 1)] + [(54, 28)] * 7 + [(82, 56)]
    assert 51.3 - 25.3 != 26.0
    found = replenishment.low_inventory(star_of(days(pairs)), fast_percent=-1).collect()
    assert {r.reorder_point for r in found} == {26.0}
    assert [r.inventory_level for r in found if r.inventory_status == "Low Inventory"] == [26]


def test_records_without_price_drop_out_only_where_prices_matter(star_of):
    full = star_of(
        flat(days([(10, 2), (12, 3)], product_id="P1"), days([(9, 1)], product_id="P2"))
    )
    from shelflight import Star

    bare = Star(
        **{n: full.table(n) for n in ("stores", "products", "seasonality", "inventory")},
        pricing=full.pricing.where("product_id = 'P1' and record_date = '2022-01-01'"),
    )
    assert [r.product_id for r in demand.competitor_pricing(bare).collect()] == ["P1"]
    assert [r.product_id for r in demand.turnover(bare).collect()] == ["P1"]
    advice = replenishment.stock_recommendations(bare).collect()
    assert [r.product_id for r in advice] == ["P1"]
    # Stock of all records, holding cost of the priced one: 10 * 10.
    assert (advice[0].current_avg_inventory, advice[0].holding_cost) == (11.0, 100.0)
    assert stock_health.movement(bare).count() == 2


def test_no_sales_gives_no_age_and_no_division(star_of):
    star = star_of(days([(10, 0), (12, 0)]))
    row = demand.kpi_summary(star).first()
    assert row.estimated_inventory_age_days is None
    zero = star_of(days([(0, 0)]))
    assert demand.turnover(zero).first().inventory_turnover_ratio is None
