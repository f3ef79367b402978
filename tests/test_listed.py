"""Listed files: slices either way, column against column, pages; few files are opened."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelflight import REPORTS
from shelflight.listed import (
    chosen_files,
    column_codes,
    inventory_above,
    list_files,
    listing,
    may_hold,
    read_files,
    read_page,
    read_slice,
    save_by_excess,
    save_sliceable,
    write_pages,
)
from shelflight.schemas import TABLES
from shelflight.star import Star
from tests.conftest import DAY

STORES = PRODUCTS = 30


def star_over(spark, inventory):
    empty = {n: spark.createDataFrame([], TABLES[n]) for n in ("stores", "seasonality", "store_events")}
    products = inventory.select("product_id").where("product_id is not null").distinct()
    price = [F.lit(1).cast(f.dataType).alias(f.name) for f in TABLES["pricing"].fields[3:]]
    return Star(
        inventory=inventory,
        pricing=inventory.select("store_region_id", "product_id", "record_date", *price),
        products=products.withColumn("category", F.lit("Toys")).to(TABLES["products"]),
        **empty,
    )


@pytest.fixture(scope="module")
def grid(spark):
    """Every product in every store for ten days, and one store-product of a third of all records."""
    even = STORES * PRODUCTS * 10
    rows = spark.range(0, even * 3 // 2, 1, 4).selectExpr(
        f"date_add(date'{DAY}', cast(if(id < {even}, id % 10, id) as int)) as record_date",
        f"concat('S', if(id < {even}, lpad(cast(id / 10 % {STORES} as int), 2, '0'), '07'), '_North') as store_region_id",
        f"concat('P', if(id < {even}, lpad(cast(id / {10 * STORES} as int), 2, '0'), '07')) as product_id",
        "cast(id % 91 as int) as inventory_level", "cast(id % 17 as int) as units_sold",
        "cast(1 as int) as units_ordered", "cast(40 + id % 7 as decimal(10,2)) as demand_forecast",
    )
    return star_over(spark, rows.to(TABLES["inventory"]))


@pytest.fixture(scope="module")
def sliceable(grid, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sliceable") / "star")
    save_sliceable(grid, folder, file_rows=200)
    return folder


def rows_of(frame):
    return sorted(map(str, frame.collect()))


GIVEN = [
    {"product_id": "P11"}, {"store_region_id": "S19_North"}, {"product_id": "P07"},
    {"product_id": "P07", "store_region_id": "S07_North"}, {"product_id": "absent"}, {},
]


@pytest.mark.parametrize("given", GIVEN, ids=str)
def test_slices_equal_those_of_the_whole_star(spark, grid, sliceable, given):
    star = read_slice(spark, sliceable, **given)
    assert rows_of(star.inventory) == rows_of(grid.sliced(**given).inventory)
    assert rows_of(REPORTS["movement"].rows(star)) == rows_of(REPORTS["movement"].rows(grid.sliced(**given)))
    assert rows_of(star.pricing) == rows_of(grid.sliced(**given).pricing)


@pytest.mark.parametrize("column,value", [("product_id", "P11"), ("store_region_id", "S19_North")])
def test_either_slice_opens_a_small_share_of_the_files(spark, sliceable, column, value):
    path = f"{sliceable}/inventory"
    files = listing(spark, path).count()
    assert files > 40
    assert 1 <= len(chosen_files(spark, path, may_hold(column, value))) <= files // 4
    # The plan reads those files and no others.
    read = read_slice(spark, sliceable, **{column: value}).inventory
    assert len(read.inputFiles()) <= files // 4


def test_a_hot_store_product_spans_files_of_even_size(spark, sliceable):
    path = f"{sliceable}/inventory"
    both = may_hold("product_id", "P07") & may_hold("store_region_id", "S07_North")
    assert len(chosen_files(spark, path, both)) > 10
    sizes = [row["rows"] for row in listing(spark, path).collect()]
    assert sum(sizes) == STORES * PRODUCTS * 15 and max(sizes) < 3 * 200


def test_codes_are_shares_in_the_order_of_the_values(spark, grid):
    def gathered(code):
        return sum((code >> 2 * bit & 1) << bit for bit in range(16))

    codes = {r.product_id: gathered(r.code) for r in column_codes(grid.inventory, "product_id").collect()}
    counts = {r.product_id: r["count"] for r in grid.inventory.groupBy("product_id").count().collect()}
    total, before = sum(counts.values()), 0
    for product in sorted(counts):
        assert codes[product] == before * 65536 // total
        before += counts[product]


def test_rows_without_a_key_are_kept_by_unsliced_reads(spark, grid, tmp_path):
    extra = spark.sql("select date'2022-01-01', null, 'P01', 1, 1, 1, cast(1 as decimal(10,2))")
    inventory = grid.inventory.limit(50).unionAll(extra).unionAll(extra)
    save_sliceable(star_over(spark, inventory), str(tmp_path / "s"), file_rows=10)
    assert rows_of(read_slice(spark, str(tmp_path / "s")).inventory) == rows_of(inventory)


def test_empty_star(spark, tmp_path):
    star = star_over(spark, spark.createDataFrame([], TABLES["inventory"]))
    save_sliceable(star, str(tmp_path / "s"))
    assert read_slice(spark, str(tmp_path / "s"), product_id="P01").inventory.count() == 0
    save_by_excess(star, str(tmp_path / "e"))
    assert inventory_above(spark, str(tmp_path / "e"), 2).count() == 0


# ---- overstock -----------------------------------------------------------------


@pytest.mark.parametrize("factor", [0, 1, 2, 5])
def test_overstock_from_chosen_files(spark, grid, tmp_path, factor):
    path = str(tmp_path / "excess")
    save_by_excess(grid, path, file_rows=200)
    pruned = Star(inventory=inventory_above(spark, path, factor))
    report = REPORTS["overstock"]
    assert rows_of(report.rows(pruned, factor=factor)) == rows_of(report.rows(grid, factor=factor))
    if factor == 2:
        files = listing(spark, path).count()
        found = report.rows(pruned).count()
        assert 0 < found and len(pruned.inventory.inputFiles()) <= files * found / 13_500 + 2 < files / 2


def test_stock_on_the_bound_and_odd_forecasts(spark, tmp_path):
    values = [(10, "5"), (11, "5"), (1, "0"), (0, "0"), (3, "-1"), (None, "4"), (4, None), (-9, "-5"), (7, "3.33")]
    rows = spark.createDataFrame(
        [(DAY, f"S{i}_N", "P", s, 0, 0, f) for i, (s, f) in enumerate(values)],
        "record_date date, store_region_id string, product_id string, inventory_level int, "
        "units_sold int, units_ordered int, demand_forecast string",
    ).withColumn("demand_forecast", F.col("demand_forecast").cast("decimal(10,2)"))
    star = star_over(spark, rows)
    save_by_excess(star, str(tmp_path / "e"), file_rows=1)
    for factor in (0, 1, 2, 3):
        pruned = Star(inventory=inventory_above(spark, str(tmp_path / "e"), factor))
        assert rows_of(REPORTS["overstock"].rows(pruned, factor=factor)) == rows_of(
            REPORTS["overstock"].rows(star, factor=factor)
        )
    with pytest.raises(ValueError):
        inventory_above(spark, str(tmp_path / "e"), -1)


def test_files_by_any_expression(spark, tmp_path):
    spark.range(0, 100, 1, 5).write.parquet(str(tmp_path / "t/rows"))
    list_files(spark, str(tmp_path / "t"), {"gap": 2 * F.col("id") - 50})
    found = read_files(spark, str(tmp_path / "t"), F.col("greatest_gap") >= 100)
    assert len(found.inputFiles()) == 2 and found.where("2 * id - 50 >= 100").count() == 25


# ---- pages ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark, grid, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "levels")
    # Small results would be merged into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1000")
    try:
        write_pages(REPORTS["stock_level"], grid, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return path


PAGES = [(1, 10), (995, 1_005), (3_000, 6_000), (13_490, 13_600), (20_000, 20_010), (1, 13_500)]


@pytest.mark.parametrize("first,last", PAGES)
def test_pages_equal_the_presented_order(spark, grid, pages, first, last):
    expected = [r.asDict() for r in REPORTS["stock_level"].ordered(grid).collect()][first - 1 : last]
    page = read_page(spark, pages, first, last)
    found = [r.asDict() for r in page.orderBy("position").collect()]
    assert [r.pop("position") for r in found] == list(range(first, first + len(expected)))
    assert found == expected


def test_a_page_opens_the_files_that_hold_it(spark, pages):
    assert listing(spark, pages).count() >= 13
    assert len(read_page(spark, pages, 1, 10).inputFiles()) <= 1
    plan = read_page(spark, pages, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(__at)" in plan and "Sort" not in plan.replace("SortMerge", "")
