"""Thresholds, flags and rates against brute force, with skew, NULLs and exact ties."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelflight.operators.profile import (
    flag_below,
    group_moments,
    merge_moments,
    net_stock,
    settled_moments,
    understock_profile,
    with_threshold,
)
from shelflight.plans import stock_health
from tests.conftest import days, flat

KEYS = ["store_region_id", "product_id"]


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "store_region_id string, product_id string, inventory_level int, units_sold int"
    )


def profile_of(facts, sigma):
    return understock_profile(facts, settled_moments(facts, KEYS), KEYS, sigma)


def below_by_hand(nets, sigma):
    """net < mean - sigma * deviation, decided without floating point."""
    nets = [n for n in nets if n is not None]
    n, s1, s2 = len(nets), sum(nets), sum(x * x for x in nets)
    factor = Fraction(str(sigma)) ** 2
    return sum(1 for x in nets if s1 > n * x and (s1 - n * x) ** 2 > factor * (n * s2 - s1 * s1))


@pytest.mark.parametrize("sigma", [1.0, 1.3])
def test_profile_matches_brute_force_with_a_hot_group(spark, sigma):
    draw = random.Random(7)
    rows = [("S_hot", "P", draw.randrange(0, 60), draw.randrange(0, 40)) for _ in range(3000)]
    for i in range(6000):
        stock = None if i % 97 == 0 else draw.randrange(0, 500)
        sold = None if i % 89 == 0 else draw.randrange(0, 300)
        rows.append((f"S{draw.randrange(9)}", f"P{draw.randrange(7)}", stock, sold))
    groups = defaultdict(list)
    for store, product, stock, sold in rows:
        groups[store, product].append((stock, sold))
    result = profile_of(frame(spark, rows), sigma).collect()
    assert len(result) == len(groups)
    for row in result:
        pairs = groups[row.store_region_id, row.product_id]
        nets = [a - b if a is not None and b is not None else None for a, b in pairs]
        known = [x for x in nets if x is not None]
        sold = [b for _, b in pairs if b is not None]
        stock = [a for a, _ in pairs if a is not None]
        mean, mean_sold = sum(known) / len(known), sum(sold) / len(sold)
        spread = math.sqrt(sum((x - mean) ** 2 for x in known) / len(known))
        assert row.total_days == len(pairs)
        assert row.understock_days == below_by_hand(nets, sigma)
        assert row.understock_percentage == pytest.approx(100 * row.understock_days / len(pairs))
        assert row.threshold == pytest.approx(mean - sigma * spread)
        assert row.spread_net == pytest.approx(spread)
        assert row.mean_inventory == sum(stock) / len(stock)
        assert row.mean_sales == mean_sold
        assert row.spread_sales == pytest.approx(
            math.sqrt(sum((x - mean_sold) ** 2 for x in sold) / len(sold))
        )


def test_moments_merge(spark):
    draw = random.Random(5)
    rows = [
        (f"S{draw.randrange(4)}", f"P{draw.randrange(3)}", draw.randrange(99), 7)
        for _ in range(500)
    ]
    facts = frame(spark, rows)
    merged = merge_moments(group_moments(facts, KEYS), ["product_id"])
    direct = group_moments(facts, ["product_id"]).select(merged.columns)
    assert sorted(merged.collect()) == sorted(direct.collect())


def test_records_are_not_shuffled_for_the_threshold_join(spark, tmp_path):
    rows = [("S", f"P{i % 5}", i % 20, 0) for i in range(500)]
    frame(spark, rows).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.schema(frame(spark, []).schema).parquet(str(tmp_path / "facts"))
    limits = with_threshold(settled_moments(facts, KEYS), 1.0)
    flagged = flag_below(facts.withColumn("net", net_stock()).join(limits, KEYS), 1.0)
    flagged.collect()
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan


def test_a_net_exactly_on_the_threshold_is_not_flagged(spark):
    # Nets 1, 1, 3, 3 have mean 2 and deviation 1; nets 2, 1, 1, 2, 0, 0 and so
    # on cover means without an exact double.
    tied = [("S", "P", n, 0) for n in (1, 1, 3, 3)]
    thirds = [("S", "Q", n, 0) for n in (1, 1, 3)]
    profile = profile_of(frame(spark, tied + thirds), 1.0)
    found = {r.product_id: r.understock_days for r in profile.collect()}
    assert found == {"P": 0, "Q": below_by_hand([1, 1, 3], 1.0)}


def test_single_row_group_has_zero_deviation(spark):
    row = profile_of(frame(spark, [("S", "P", 9, 4)]), 1.3).first()
    assert (row.threshold, row.spread_net, row.understock_days, row.total_days) == (5.0, 0.0, 0, 1)


def test_group_without_any_net_is_not_flagged(spark):
    rows = [("S", "P", None, 4), ("S", "P", 3, None)]
    row = profile_of(frame(spark, rows), 1.0).first()
    assert (row.threshold, row.understock_days, row.total_days) == (None, 0, 2)


def test_threshold_join_and_counts_flag_the_same_rows(spark):
    draw = random.Random(3)
    rows = [
        (f"S{draw.randrange(3)}", f"P{draw.randrange(4)}", draw.randrange(99), draw.randrange(50))
        for _ in range(800)
    ]
    facts = frame(spark, rows)
    limits = with_threshold(group_moments(facts, KEYS), 1.0)
    joined = flag_below(facts.withColumn("net", net_stock()).join(limits, KEYS), 1.0)
    by_rows = {
        (r[0], r[1]): r.n
        for r in joined.groupBy(*KEYS).agg(F.count_if("below").alias("n")).collect()
    }
    profile = profile_of(facts, 1.0).collect()
    assert by_rows == {(r[0], r[1]): r.understock_days for r in profile}


def test_large_levels_keep_their_deviation(spark):
    base = 2_000_000_000
    rows = [("S", "P", base + d, 0) for d in (0, 0, 2, 2)]
    row = profile_of(frame(spark, rows), 1.0).first()
    assert row.spread_net == 1.0


def test_median_of_even_and_odd_groups(star_of):
    star = star_of(
        flat(
            days([(9, 1), (9, 2), (9, 8), (9, 8)], product_id="even"),
            days([(9, 5), (9, 1), (9, 3)], product_id="odd"),
            days([(9, 4)], product_id="one"),
        )
    )
    rows = {r.product_id: r for r in stock_health.sales_profile(star).collect()}
    assert rows["even"].median_sales == 5.0
    assert rows["odd"].median_sales == 3.0
    assert (rows["one"].median_sales, rows["one"].stddev_sales) == (4.0, 0.0)
    assert rows["even"].avg_sales == 4.75
