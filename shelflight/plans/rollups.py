"""Roll-ups behind the dashboard views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.numeric import amount_ratio, ratio
from shelflight.operators.sums import stock_sums
from shelflight.plans.demand import product_turnover
from shelflight.plans.replenishment import low_records, reorder_points
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import Star


def _by_product_and_store(rows: DataFrame):
    """Group once by product and once by store-region, in one pass over the rows."""
    return rows.groupingSets([["product_id"], ["store_region_id"]], *STORE_PRODUCT)


def _dimension() -> list:
    by_product = F.col("store_region_id").isNull()
    return [
        F.when(by_product, "product").otherwise("store_region").alias("dimension"),
        F.coalesce("product_id", "store_region_id").alias("member"),
    ]


def low_inventory_rollup(star: Star) -> DataFrame:
    """Records at or below the reorder point, by product and by store-region."""
    per_pair = low_records(star)
    rolled = _by_product_and_store(per_pair).agg(
        F.sum("low").alias("low_inventory_records"), F.sum("records").alias("total_records")
    )
    share = ratio(F.col("low_inventory_records") * 100, F.col("total_records"))
    return rolled.select(
        *_dimension(),
        "low_inventory_records",
        "total_records",
        F.round(share, 2).alias("low_inventory_percentage"),
    )


def reorder_vs_sales_rollup(star: Star) -> DataFrame:
    """Mean reorder point beside mean sales, by product and by store-region."""
    cents = "decimal(20,2)"
    points = reorder_points(star).select(
        *STORE_PRODUCT,
        F.col("reorder_point").cast(cents).alias("reorder_point"),
        F.col("avg_sales").cast(cents).alias("avg_sales"),
    )
    rolled = _by_product_and_store(points).agg(
        F.round(amount_ratio(F.sum("reorder_point"), F.count("reorder_point")), 2).alias(
            "avg_reorder_point"
        ),
        F.round(amount_ratio(F.sum("avg_sales"), F.count("avg_sales")), 2).alias("avg_sales"),
    )
    return rolled.select(*_dimension(), "avg_reorder_point", "avg_sales")


def monthly_trend(star: Star) -> DataFrame:
    """Sales and forecast per month of each year."""
    month = F.trunc("record_date", "month").alias("month_start")
    return stock_sums(star, [month], "sold", "forecast").select(
        "month_start",
        F.col("sold_sum").alias("total_units_sold"),
        F.col("forecast_sum").alias("total_forecast"),
    )


def turnover_by_category(star: Star) -> DataFrame:
    """Turnover of a category from summed parts, not a mean of product ratios."""
    cost = F.round("cost_of_goods", 2).cast("decimal(28,2)")
    grouped = (
        product_turnover(star)
        .groupBy("category")
        .agg(
            F.sum(cost).alias("cost"),
            ratio(F.sum("stock_sum"), F.sum("stock_rows")).alias("mean_stock"),
        )
    )
    return grouped.select(
        "category",
        F.col("cost").cast("double").alias("approx_cogs"),
        F.round("mean_stock", 2).alias("avg_inventory"),
        rules.turnover_ratio(F.col("cost"), F.col("mean_stock")).alias("inventory_turnover_ratio"),
    )
