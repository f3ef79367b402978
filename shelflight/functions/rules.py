"""Business rules as column functions: labels, ratings, stock targets, actions.

Thresholds that differ between reports are arguments, never shared constants.
Every CASE whose test is NULL falls through to its last branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.functions.numeric import amount_ratio, larger, mean_product, ratio, whole, whole_text

# Label texts as they appear in the reports.
FAST_SELLING = "Fast-selling"
FAST_MOVING = "Fast-moving"
SLOW_MOVING = "Slow-moving"

# Holding-cost limits, target factors and cost shares.
HIGH_HOLDING_COST = 1000
RAISED_HOLDING_COST = 500
URGENT_UNDERSTOCK_PERCENT = 15
FAST_SPREAD_FACTOR = 1.5
SLOW_SPREAD_FACTOR = 0.5
SERVICE_FACTOR = 1.65
LEAD_TIME_DAYS = 7
SAFETY_FLOOR_DAYS = 3
REDUCTION_SHARE = 0.3
REDUCTION_COST_SHARE = 0.25
INCREASE_COST_SHARE = 0.1


# ---- stock flags and movement ------------------------------------------------


def share_over(part: Column, rows: Column, percent: int) -> Column:
    """part is more than percent of rows; whole numbers, so exact on the edge."""
    return whole(part) * 100 > whole(rows) * percent


def movement(
    understock_days: Column,
    total_days: Column,
    percent: int,
    fast: str = FAST_SELLING,
    slow: str = SLOW_MOVING,
) -> Column:
    return F.when(share_over(understock_days, total_days, percent), fast).otherwise(slow)


def stock_status(below: Column) -> Column:
    return F.when(below, "Understock").otherwise("Normal")


def inventory_status(inventory_level: Column, reorder_point: Column) -> Column:
    return F.when(inventory_level <= reorder_point, "Low Inventory").otherwise("Sufficient")


def store_performance(rate: Column, benchmark: Column) -> Column:
    return F.when(rate < benchmark, "Good Performance").otherwise(
        "Poor Performance - High Stockouts"
    )


# ---- replenishment -----------------------------------------------------------


def reorder_point(is_fast: Column, mean_net: Column, spread_net: Column) -> Column:
    """Mean stock left after sales; slow movers give up half a deviation."""
    return F.when(is_fast, mean_net).otherwise(mean_net - 0.5 * spread_net)


def safety_stock(mean_sales: Column, spread_sales: Column) -> Column:
    lead = F.sqrt(F.lit(float(LEAD_TIME_DAYS)))
    return larger(SERVICE_FACTOR * spread_sales * lead, mean_sales * SAFETY_FLOOR_DAYS)


def optimal_stock(is_fast: Column, mean_sales: Column, spread_sales: Column) -> Column:
    return F.when(is_fast, mean_sales + FAST_SPREAD_FACTOR * spread_sales).otherwise(
        mean_sales + SLOW_SPREAD_FACTOR * spread_sales
    )


def holding_cost(
    stock_sum: Column, stock_rows: Column, price_sum: Column, price_rows: Column
) -> Column:
    """Mean stock times mean price."""
    return mean_product(stock_sum, stock_rows, price_sum, price_rows)


def stock_cut(mean_inventory: Column, optimal: Column) -> Column:
    """Units to take out of a slow mover's stock."""
    return larger(mean_inventory * REDUCTION_SHARE, mean_inventory - optimal)


def recommendation(
    is_fast: Column, mean_inventory: Column, optimal: Column, cost: Column
) -> Column:
    slow = ~is_fast
    return (
        F.when(
            slow & (cost > HIGH_HOLDING_COST),
            F.concat(
                F.lit("REDUCE: High holding cost slow-mover. Reduce by "),
                whole_text(stock_cut(mean_inventory, optimal)),
                F.lit(" units to optimize costs"),
            ),
        )
        .when(
            slow & (cost <= HIGH_HOLDING_COST),
            "MAINTAIN: Low-cost slow-mover. Current level acceptable, monitor sales trends",
        )
        .when(
            is_fast & (mean_inventory < optimal),
            F.concat(
                F.lit("INCREASE: Fast-seller understocked. Increase by "),
                whole_text(optimal - mean_inventory),
                F.lit(" units to prevent stockouts"),
            ),
        )
        .when(
            is_fast & (mean_inventory >= optimal),
            F.concat(
                F.lit("OPTIMIZE: Fast-seller well-stocked. Fine-tune to "),
                whole_text(optimal),
                F.lit(" units for efficiency"),
            ),
        )
        .otherwise("REVIEW: Analyze sales pattern and adjust accordingly")
    )


def priority(
    is_fast: Column,
    is_urgent: Column,
    mean_inventory: Column,
    optimal: Column,
    cost: Column,
) -> Column:
    """5 is the most pressing."""
    slow = ~is_fast
    return (
        F.when(slow & (cost > HIGH_HOLDING_COST), 5)
        .when(is_fast & is_urgent, 4)
        .when(is_fast & (mean_inventory < optimal), 3)
        .when(slow & (cost > RAISED_HOLDING_COST), 2)
        .otherwise(1)
    )


def cost_impact(
    is_fast: Column, mean_inventory: Column, optimal: Column, cost: Column, mean_price: Column
) -> Column:
    saved = stock_cut(mean_inventory, optimal) * mean_price * REDUCTION_COST_SHARE
    spent = (optimal - mean_inventory) * mean_price * INCREASE_COST_SHARE
    return (
        F.when(~is_fast & (cost > HIGH_HOLDING_COST), F.round(saved, 2))
        .when(is_fast & (mean_inventory < optimal), F.round(spent, 2))
        .otherwise(F.lit(0.0))
    )


# ---- efficiency --------------------------------------------------------------


def turnover_ratio(cost_of_goods: Column, mean_inventory: Column) -> Column:
    return F.round(ratio(cost_of_goods, mean_inventory), 2)


def inventory_age(mean_sales: Column, days: Column) -> Column:
    """Days of stock on hand, NULL unless something sells."""
    return F.when(mean_sales > 0, F.round(days, 2))


def forecast_quality(error: Column) -> Column:
    return F.when(error < 10, "Good Forecast").otherwise("Poor Forecast")


# ---- seasonal demand ---------------------------------------------------------


def sales_position(value: Column, top: Column, bottom: Column, above_mean: Column) -> Column:
    return (
        F.when(value == top, "PEAK MONTH")
        .when(value == bottom, "TROUGH MONTH")
        .when(above_mean, "Above Average")
        .otherwise("Below Average")
    )


def forecast_position(value: Column, top: Column, bottom: Column, above_mean: Column) -> Column:
    return (
        F.when(value == top, "PEAK FORECAST")
        .when(value == bottom, "TROUGH FORECAST")
        .when(above_mean, "Above Avg Forecast")
        .otherwise("Below Avg Forecast")
    )


def percentage_error(sales: Column, forecast: Column) -> Column:
    return F.round(amount_ratio(F.abs(sales - forecast) * 100, sales), 2)


def accuracy_rating(sales: Column, forecast: Column) -> Column:
    """Grade of the error as a share of sales; no sales gives the last grade."""
    error = F.abs(sales - forecast) * 100
    base = F.abs(F.nullif(sales, F.lit(0)))
    return (
        F.when(error < base * 5, "Excellent Forecast")
        .when(error < base * 10, "Good Forecast")
        .when(error < base * 20, "Fair Forecast")
        .when(error < base * 30, "Poor Forecast")
        .otherwise("Very Poor Forecast")
    )


def forecast_bias(sales: Column, forecast: Column) -> Column:
    """More than a tenth above or below sales."""
    return (
        F.when(forecast * 10 > sales * 11, "Over-Forecasted")
        .when(forecast * 10 < sales * 9, "Under-Forecasted")
        .otherwise("Well-Calibrated")
    )


def region_rating(sales: Column, total: Column, months: Column) -> Column:
    """A month's sales against 120%, 100% and 80% of the mean month (total / months)."""
    scaled = whole(sales) * whole(months) * 10
    mean = whole(total)
    return (
        F.when(scaled > mean * 12, "High Performing Region")
        .when(scaled > mean * 10, "Good Performing Region")
        .when(scaled > mean * 8, "Average Performing Region")
        .otherwise("Low Performing Region")
    )


def variance_from_mean(value: Column, total: Column, months: Column) -> Column:
    """Percent above or below the mean month (total / months)."""
    gap = (value * whole(months) - total) * 100
    return F.round(ratio(whole(gap * 100), whole(total * 100)), 2)


def trend_projection(sales: Column, previous: Column) -> Column:
    """Next month if half of the last change repeats; NULL in the first month."""
    return F.round(sales + (sales - previous) * 0.5, 2)
