"""Medians of large groups by ranges: exact, with bounded rows of a group in a task."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelflight.operators.selection import _one_round, middle_values
from shelflight.plans.stock_health import sales_profile, sales_profile_selected
from shelflight.storage import settle
from tests.conftest import DAY


def limits_of(records):
    v = F.col("v")
    limits = records.groupBy("g").agg(
        F.count("*").alias("rows"), F.count(v).alias("known"), F.min(v).alias("least"), F.max(v).alias("greatest")
    )
    return settle(limits, "limits")


def middles(records, **options):
    found = middle_values(records, ["g"], F.col("v"), limits_of(records), **options).collect()
    assert len({r.g for r in found}) == len(found)
    return {r.g: (r.lower, r.upper) for r in found}


def expected(groups):
    def two(values):
        ordered = sorted(values, key=lambda v: (v is not None, v or 0))
        return ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]

    return {g: two(values) for g, values in groups.items()}


@pytest.mark.parametrize("ranges", [2, 3, 16, 1024])
def test_middle_values_equal_a_sort(spark, ranges):
    draw = random.Random(ranges)
    groups = {
        "one": [7], "two": [-5, 9], "nulls": [None, None, None], "half": [None, 4], "most": [None, None, 3],
        "even split": [None, None, 8, 5], "same": [6] * 31, "ties": [1] * 10 + [2] * 10,
        "edges": [-(2**31), 2**31 - 1, 0, 1], "far": [0] * 5 + [2**31 - 1] * 5,
    }
    for i in range(25):
        wide = draw.choice([3, 100, 2**31 - 1])
        groups[f"r{i}"] = [
            None if draw.random() < 0.1 else draw.randint(-wide, wide) for _ in range(draw.randint(1, 120))
        ]
    rows = [(g, v) for g, values in groups.items() for v in values]
    records = spark.createDataFrame(rows, "g string, v int")
    assert middles(records, ranges=ranges) == expected(groups)


def test_a_round_needs_two_ranges(spark):
    records = spark.createDataFrame([("a", 1)], "g string, v int")
    with pytest.raises(ValueError):
        middles(records, ranges=1)


def test_empty_table(spark):
    assert middles(spark.createDataFrame([], "g string, v int")) == {}


def test_a_million_values_never_meet_in_a_task(spark):
    """The hot group has a third of all records, each another value."""
    n = 1_000_000
    hot = spark.range(0, n, 1, 8).selectExpr("'hot' as g", "cast(pmod(id * 7919, 1000003) as int) as v")
    rest = spark.range(0, 2 * n, 1, 8).selectExpr("concat('g', id % 1000) as g", "cast(id % 17 as int) as v")
    records = settle(hot.unionByName(rest), "million")
    found = middles(records)
    values = sorted(i * 7919 % 1000003 for i in range(n))
    assert found["hot"] == (values[n // 2 - 1], values[n // 2])
    assert len(found) == 1001
    # What a round shuffles of a group is at most a row for each range and task.
    limits = limits_of(records).where("g = 'hot'").selectExpr(
        "g", "cast(least as bigint) as __least", "cast(greatest as bigint) as __greatest",
        f"cast({n // 2 - 1} as bigint) as __rank", "rows as __rows",
    )
    first = _one_round(records.selectExpr("g", "cast(v as bigint) as __value"), limits, ["g"], 64)
    row = first.first()
    assert row["__greatest"] - row["__least"] <= 1_000_003 // 64 + 1
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("ranges", [2, 1024])
def test_the_report_is_the_same(spark, star_of, ranges):
    draw = random.Random(5)
    rows = [
        {
            "product_id": f"P{draw.randint(1, 6)}",
            "record_date": DAY + dt.timedelta(days=i),
            "units_sold": draw.choice([None, *range(40)]),
        }
        for i in range(90)
    ]
    star = star_of(rows + [{"product_id": "P9", "units_sold": None}])
    plain = sorted(map(tuple, sales_profile(star).collect()))
    assert sorted(map(tuple, sales_profile_selected(star, ranges).collect())) == plain
    medians = {r.product_id: r.median_sales for r in sales_profile_selected(star, ranges).collect()}
    by_product = {}
    for row in star.inventory.collect():
        by_product.setdefault(row.product_id, []).append(row.units_sold)
    for product, values in by_product.items():
        if None not in values:
            assert medians[product] == statistics.median(values)
    assert medians["P9"] is None
