"""The raw file: formats accepted, lines refused, and the whole load."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from shelflight import load_star
from shelflight.operators.quality import KeyViolation
from shelflight.plans.load import load_warnings
from shelflight.schemas import STAGING, TABLES
from shelflight.sources.csv_records import (
    read_explained,
    read_strict,
    read_tolerant,
    write_records,
)

HEADER = (
    "Date,Store ID,Product ID,Category,Region,Inventory Level,Units Sold,Units Ordered,"
    "Demand Forecast,Price,Discount,Weather Condition,Holiday/Promotion,Competitor Pricing,"
    "Seasonality"
)
GOOD = "2022-01-01,S001,P0001,Toys,North,231,127,55,135.47,33.50,20,Rainy,0,29.69,Autumn"


def write(tmp_path, *lines, end="\n"):
    path = tmp_path / "records.csv"
    path.write_text(end.join([HEADER, *lines]) + end)
    return str(path)


def test_one_record(spark, tmp_path):
    rows = read_strict(spark, write(tmp_path, GOOD))
    assert rows.schema == STAGING
    row = rows.first()
    assert row.record_date == dt.date(2022, 1, 1)
    assert row.store_region_id == "S001_North"
    assert (row.inventory_level, row.units_sold, row.units_ordered) == (231, 127, 55)
    assert (row.demand_forecast, row.discount) == (Decimal("135.47"), Decimal("20.00"))
    assert row.holiday_promotion is False


def test_quotes_short_dates_nulls_and_carriage_returns(spark, tmp_path):
    line = '2022-1-5,S001,P0001,"Toys, games",North,231,127,\\N,135.47,33.50,20,"Rainy",1,29.69,Autumn'
    row = read_strict(spark, write(tmp_path, line, end="\r\n")).first()
    assert row.record_date == dt.date(2022, 1, 5)
    assert (row.category, row.weather_condition) == ("Toys, games", "Rainy")
    assert row.units_ordered is None
    assert row.holiday_promotion is True
    assert row.seasonality == "Autumn"


def test_quotes_inside_quoted_fields_are_doubled(spark, tmp_path):
    line = GOOD.replace("Toys", '"Toys ""R"" Us"').replace("Rainy", '"Toys 12"", big"')
    row = read_strict(spark, write(tmp_path, line)).first()
    assert (row.category, row.weather_condition) == ('Toys "R" Us', 'Toys 12", big')


def test_blank_texts_are_empty_and_nulls_are_null(spark, tmp_path):
    first = GOOD.replace("North", "").replace("Toys", '""')
    second = GOOD.replace("Toys", "\\N").replace("P0001", "P0002").replace("231", "\\N")
    rows = {r.product_id: r for r in read_strict(spark, write(tmp_path, first, second)).collect()}
    assert (rows["P0001"].region, rows["P0001"].store_region_id) == ("", "S001_")
    assert rows["P0001"].category == ""
    assert rows["P0002"].category is None and rows["P0002"].inventory_level is None


BAD = [
    GOOD.replace("2022-01-01", "01/02/2022"),
    GOOD.replace("231", "many"),
    GOOD.replace("33.50", "123456789012.50"),
    GOOD.rsplit(",", 3)[0],
    GOOD.replace("231", ""),
    GOOD.replace("2022-01-01", ""),
    GOOD.replace("33.50", ""),
    GOOD.replace(",0,", ",2,"),
    GOOD.replace(",0,", ",,"),
    GOOD + ",more",
]


@pytest.mark.parametrize("line", BAD)
def test_strict_load_fails_on_a_bad_line(spark, tmp_path, line):
    with pytest.raises(Exception, match="(?i)malformed|failed"):
        load_star(spark, write(tmp_path, GOOD, line), str(tmp_path / "star"))


def test_tolerant_load_sets_bad_lines_aside(spark, tmp_path):
    accepted, rejected = read_tolerant(spark, write(tmp_path, GOOD, *BAD))
    assert accepted.count() == 1
    assert accepted.schema == STAGING
    assert rejected.count() == len(BAD)
    assert sorted(r.rejected_line for r in rejected.collect()) == sorted(BAD)


def test_written_records_read_back(spark, staging_of, tmp_path):
    rows = staging_of([{"category": 'a "b", c', "units_ordered": None}, {"holiday_promotion": True}])
    write_records(rows, str(tmp_path / "out"))
    back = read_strict(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_whole_load(spark, tmp_path):
    other = GOOD.replace("P0001", "P0002").replace("Toys", "Food")
    star = load_star(spark, write(tmp_path, GOOD, other), str(tmp_path / "star"))
    assert {name: star.table(name).count() for name in TABLES} == {
        "stores": 1,
        "products": 2,
        "seasonality": 2,
        "inventory": 2,
        "pricing": 2,
        "store_events": 1,
    }


def test_load_refuses_a_repeated_inventory_key(spark, tmp_path):
    with pytest.raises(KeyViolation, match="1 repeated"):
        load_star(spark, write(tmp_path, GOOD, GOOD), str(tmp_path / "star"))


def test_tolerant_whole_load_keeps_the_rejects(spark, tmp_path):
    path = write(tmp_path, GOOD, BAD[1])
    star = load_star(spark, path, str(tmp_path / "star"), tolerant=True)
    assert star.inventory.count() == 1
    assert spark.read.parquet(str(tmp_path / "star/rejected")).count() == 1


def test_lines_set_aside_carry_their_reasons(spark, tmp_path):
    def line(**fields):
        names = ["date", "store", "product", "category", "region", "stock", "sold", "ordered"]
        parts = GOOD.split(",")
        for name, text in fields.items():
            parts[names.index(name)] = text
        return ",".join(parts)

    path = write(
        tmp_path, GOOD, GOOD, line(store="\\N"), line(date="soon", stock=""), line(sold=" "),
        line(ordered="many"), line(ordered="1.5"), GOOD + ",more", "a,b",
    )
    accepted, explained = read_explained(spark, path)
    plain, rejected = read_tolerant(spark, path)
    assert sorted(map(str, accepted.collect())) == sorted(map(str, plain.collect()))
    assert sorted(explained.select("rejected_line").collect()) == sorted(rejected.collect())
    told = {r.rejected_line: [(w.column_name, w.code) for w in r.warnings] for r in explained.collect()}
    assert told["a,b"] == [(None, "wrong_shape")]
    assert [("record_date", "unreadable"), ("inventory_level", "blank")] in told.values()
    counts = {
        (r.table_name, r.column_name, r.code): r["rows"] for r in load_warnings(accepted, explained).collect()
    }
    key = "record_date, store_region_id, product_id"
    assert counts == {
        ("staging", None, "wrong_shape"): 2,
        ("staging", "record_date", "unreadable"): 1,
        ("staging", "inventory_level", "blank"): 1,
        ("staging", "units_sold", "blank"): 1,
        ("staging", "units_ordered", "unreadable"): 2,
        ("inventory", key, "repeated_key"): 1,
        ("inventory", key, "no_key"): 1,
        ("pricing", "store_region_id, product_id, record_date", "no_key"): 1,
        ("stores", "store_region_id", "no_key"): 1,
        ("store_events", "store_region_id, record_date", "no_key"): 1,
    }
    nothing = load_warnings(accepted.limit(0), explained.limit(0))
    assert nothing.count() == 0
