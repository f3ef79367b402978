"""Reports on replenishment: reorder points, low inventory, safety stock, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.numeric import amount_ratio, mean_gap, ratio, scaled_spread
from shelflight.operators.profile import (
    settled_moments,
    store_product_moments,
    store_product_profile,
)
from shelflight.operators.sums import CELLS, joined_facts
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import Star
from shelflight.storage import settle


# Name under which a star knows the records at or below either reorder point.
LOW = "low inventory"
_CANDIDATES = {"point_if_fast": True, "point_if_slow": False}


def _reorder_point(fast: Column) -> Column:
    mean_net = mean_gap(
        F.col("stock_sum"), F.col("stock_rows"), F.col("sold_sum"), F.col("sold_rows")
    )
    return rules.reorder_point(fast, mean_net, F.col("spread_net"))


def _is_fast(percent: int) -> Column:
    return rules.share_over(F.col("understock_days"), F.col("total_days"), percent)


def _with_reorder_point(profile: DataFrame, fast_percent: int) -> DataFrame:
    """Add the unrounded reorder point; fast means more than ``fast_percent`` of days."""
    return profile.withColumn("reorder_point", _reorder_point(_is_fast(fast_percent)))


def reorder_points(
    star: Star, sigma: float = 1.3, label_percent: int = 10, formula_percent: int = 5
) -> DataFrame:
    """Reorder point per store-product. The label and the formula have their own
    limits, so a row labelled slow may carry the fast formula."""
    profile = store_product_profile(star, sigma)
    points = _with_reorder_point(profile, formula_percent).join(star.products, "product_id")
    label = rules.movement(
        F.col("understock_days"), F.col("total_days"), label_percent, fast=rules.FAST_MOVING
    )
    return points.select(
        *STORE_PRODUCT,
        "category",
        label.alias("movement_type"),
        F.round("reorder_point", 2).alias("reorder_point"),
        F.round("mean_inventory", 2).alias("avg_inventory"),
        F.round("mean_sales", 2).alias("avg_sales"),
        F.round("spread_net", 2).alias("stddev_inv_minus_sales"),
        "understock_days",
        "total_days",
        F.round("understock_percentage", 2).alias("understock_percentage"),
    )


def low_inventory(star: Star, sigma: float = 1.0, fast_percent: int = 5) -> DataFrame:
    """Every record's stock against the reorder point of its store-product."""
    profile = store_product_profile(star, sigma)
    points = (
        _with_reorder_point(profile, fast_percent)
        .join(star.products, "product_id")
        .select(*STORE_PRODUCT, "category", "reorder_point")
    )
    records = star.inventory.select("record_date", *STORE_PRODUCT, "inventory_level")
    return records.join(settle(points, "reorder-points"), STORE_PRODUCT).select(
        "record_date",
        *STORE_PRODUCT,
        "category",
        "inventory_level",
        F.round("reorder_point", 2).alias("reorder_point"),
        rules.inventory_status(F.col("inventory_level"), F.col("reorder_point")).alias(
            "inventory_status"
        ),
    )


def _is_low(reorder_point: str) -> Column:
    return (
        rules.inventory_status(F.col("inventory_level"), F.col(reorder_point)) == "Low Inventory"
    )


def low_records(star: Star, sigma: float = 1.0, fast_percent: int = 5) -> DataFrame:
    """Records at or below the reorder point, and all records, per store-product."""
    counted = star.known(LOW)
    if counted is None:
        return (
            low_inventory(star, sigma, fast_percent)
            .groupBy(*STORE_PRODUCT)
            .agg(
                F.count_if(F.col("inventory_status") == "Low Inventory").alias("low"),
                F.count("*").alias("records"),
            )
        )
    profile = store_product_profile(star, sigma).join(star.products, "product_id")
    low = F.when(_is_fast(fast_percent), F.col("low_if_fast")).otherwise(F.col("low_if_slow"))
    return profile.join(counted, STORE_PRODUCT).select(
        *STORE_PRODUCT, low.alias("low"), F.col("total_days").alias("records")
    )


def reorder_candidates(moments: DataFrame) -> DataFrame:
    """Both reorder points that a store-product can have, before its days are flagged."""
    spread = scaled_spread(F.col("net_rows"), F.col("net_sum"), F.col("net_squares"))
    known = moments.withColumn("spread_net", ratio(spread, F.col("net_rows")))
    return known.withColumns(
        {name: _reorder_point(F.lit(fast)) for name, fast in _CANDIDATES.items()}
    )


def low_counts() -> list[Column]:
    """Records at or below each of the two, where they carry them."""
    return [
        F.count_if(_is_low(name)).alias(name.replace("point", "low")) for name in _CANDIDATES
    ]


def _stock_targets(profile: DataFrame, fast_percent: int) -> DataFrame:
    """Add movement, safety stock and the optimal level to a profile."""
    days = F.col("understock_days"), F.col("total_days")
    fast = F.col("is_fast")
    return profile.withColumn("is_fast", rules.share_over(*days, fast_percent)).withColumns(
        {
            "product_movement": rules.movement(*days, fast_percent),
            "safety_stock": rules.safety_stock(F.col("mean_sales"), F.col("spread_sales")),
            "optimal_stock": rules.optimal_stock(fast, F.col("mean_sales"), F.col("spread_sales")),
        }
    )


def safety_stock(star: Star, sigma: float = 1.3, fast_percent: int = 10) -> DataFrame:
    """Safety stock for a seven-day lead time beside the optimal level."""
    profile = store_product_profile(star, sigma)
    return _stock_targets(profile, fast_percent).select(
        *STORE_PRODUCT,
        "product_movement",
        F.round("safety_stock", 2).alias("safety_stock"),
        F.round("optimal_stock", 2).alias("optimal_stock_level"),
    )


def _priced_moments(star: Star) -> DataFrame:
    """Moments of the store-products, and sums over their records that have a price."""
    if star.known(CELLS) is not None:
        return store_product_moments(star)
    records = joined_facts(star, ["inventory_level", "units_sold"], ["price"], "left")
    priced_stock = F.when(F.col("priced"), F.col("inventory_level"))
    return settled_moments(
        records,
        STORE_PRODUCT,
        F.count("priced").alias("priced_rows"),
        F.sum(priced_stock).alias("priced_stock_sum"),
        F.count(priced_stock).alias("priced_stock_rows"),
        F.sum("price").alias("priced_price_sum"),
        F.count("price").alias("priced_price_rows"),
    )


def stock_recommendations(star: Star, sigma: float = 1.3, fast_percent: int = 10) -> DataFrame:
    """Movement, holding cost, target level, action, priority and cost per store-product.

    Thresholds and sales come from all records, holding costs from the records
    that have a price. One left join of the two facts on their full key serves
    both kinds of sums.
    """
    profile = store_product_profile(star, sigma, _priced_moments(star))
    priced_stock_total = F.col("priced_stock_sum"), F.col("priced_stock_rows")
    price_total = F.col("priced_price_sum"), F.col("priced_price_rows")
    targets = (
        _stock_targets(profile.where(F.col("priced_rows") > 0), fast_percent)
        .withColumns(
            {
                "mean_price": amount_ratio(*price_total),
                "cost": rules.holding_cost(*priced_stock_total, *price_total),
                "is_urgent": rules.share_over(
                    F.col("understock_days"),
                    F.col("total_days"),
                    rules.URGENT_UNDERSTOCK_PERCENT,
                ),
            }
        )
        .join(star.products, "product_id")
        .join(star.seasonality, "product_id", "left_semi")
    )
    fast, cost = F.col("is_fast"), F.col("cost")
    stock, optimal = F.col("mean_inventory"), F.col("optimal_stock")
    return targets.select(
        *STORE_PRODUCT,
        "category",
        "product_movement",
        F.round(stock, 2).alias("current_avg_inventory"),
        F.round(optimal, 2).alias("recommended_stock_level"),
        F.round(optimal - stock, 2).alias("stock_adjustment"),
        F.round(cost, 2).alias("holding_cost"),
        F.round("understock_percentage", 2).alias("understock_percentage"),
        rules.recommendation(fast, stock, optimal, cost).alias("recommendation"),
        rules.priority(fast, F.col("is_urgent"), stock, optimal, cost).alias("priority_score"),
        rules.cost_impact(fast, stock, optimal, cost, F.col("mean_price")).alias(
            "estimated_cost_impact"
        ),
    )
