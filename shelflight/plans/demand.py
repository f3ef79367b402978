"""Reports on demand and efficiency: forecasts, prices, turnover, regions, KPIs, seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.numeric import amount_ratio, mean_gap, mean_ratio, ratio, whole
from shelflight.operators.profile import (
    LIMITS,
    flag_rate,
    merge_moments,
    rated,
    store_product_moments,
    store_product_profile,
    with_threshold,
)
from shelflight.operators.sums import price_sums, priced_sums, stock_sums
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import Star
from shelflight.storage import settle


def category_summary(star: Star) -> DataFrame:
    """Stock, sales and forecast per category; products are summed before they join."""
    per_product = stock_sums(star, ["product_id"], "stock", "sold", "forecast")
    return (
        per_product.join(star.products, "product_id")
        .groupBy("category")
        .agg(
            F.round(ratio(F.sum("stock_sum"), F.sum("stock_rows")), 2).alias("avg_inventory"),
            F.sum("sold_sum").alias("total_units_sold"),
            F.sum("forecast_sum").alias("total_forecast"),
        )
    )


def forecast_accuracy(star: Star) -> DataFrame:
    """Mean forecast against mean sales per store-product."""
    sums = stock_sums(star, STORE_PRODUCT, "forecast", "sold")
    forecast = F.col("forecast_sum"), F.col("forecast_rows")
    sold = F.col("sold_sum"), F.col("sold_rows")
    error = F.abs(mean_gap(*forecast, *sold))
    return sums.join(star.products, "product_id").select(
        *STORE_PRODUCT,
        "category",
        F.round(amount_ratio(*forecast), 2).alias("avg_forecast"),
        F.round(ratio(*sold), 2).alias("avg_actual_sales"),
        F.round(error, 2).alias("avg_forecast_error"),
        rules.forecast_quality(error).alias("forecast_quality"),
    )


def _mean(name: str) -> Column:
    return amount_ratio(F.col(f"priced_{name}_sum"), F.col(f"priced_{name}_rows"))


def competitor_pricing(star: Star) -> DataFrame:
    """Price gap to the competitor beside sales, per product."""
    sums = priced_sums(star, ["product_id"], "price", "competitor", "sold")
    price = F.col("priced_price_sum"), F.col("priced_price_rows")
    competitor = F.col("priced_competitor_sum"), F.col("priced_competitor_rows")
    return sums.join(star.products, "product_id").select(
        "product_id",
        "category",
        _mean("competitor").alias("avg_competitor_price"),
        F.round(mean_gap(*price, *competitor), 6).alias("Difference"),
        _mean("sold").alias("avg_units_sold"),
    )


def discount_effect(star: Star) -> DataFrame:
    """Mean discount beside mean sales, per product."""
    sums = priced_sums(star, ["product_id"], "discount", "sold")
    return sums.join(star.products, "product_id").select(
        "product_id",
        "category",
        _mean("discount").alias("avg_discount"),
        _mean("sold").alias("avg_units_sold"),
    )


def product_turnover(star: Star) -> DataFrame:
    """Unrounded cost of goods and stock sums per product.

    The mean price is one number per product, so it multiplies the product's
    sales after they are summed and both facts are reduced before they meet.
    """
    prices = price_sums(star, ["product_id"], "price").select(
        "product_id", "price_sum", "price_rows"
    )
    stock = stock_sums(star, ["product_id"], "sold", "stock").select(
        "product_id", "sold_sum", "stock_sum", "stock_rows"
    )
    cost = amount_ratio(F.col("sold_sum") * F.col("price_sum"), F.col("price_rows"))
    return (
        stock.join(prices, "product_id")
        .join(star.products, "product_id")
        .withColumn("cost_of_goods", cost)
    )


def turnover(star: Star) -> DataFrame:
    """Approximate cost of goods sold over mean stock, per product."""
    mean_stock = ratio(F.col("stock_sum"), F.col("stock_rows"))
    return product_turnover(star).select(
        "product_id",
        "category",
        F.round("cost_of_goods", 2).alias("approx_cogs"),
        F.round(mean_stock, 2).alias("avg_inventory"),
        rules.turnover_ratio(F.col("cost_of_goods"), mean_stock).alias("inventory_turnover_ratio"),
    )


def regionally_understocked(sigma: float) -> str:
    """Name under which a star knows the days below the thresholds of regions."""
    return f"understock by region {sigma}"


def region_limits(placed: DataFrame, sigma: float) -> DataFrame:
    """Store-products, given with their sums and region, with the limits of the region."""
    cells = merge_moments(placed, ["region", "product_id"])
    limits = with_threshold(cells, sigma).select("region", "product_id", *LIMITS)
    return placed.select(*STORE_PRODUCT, "region", "total_days").join(
        limits, ["region", "product_id"]
    )


def regional_summary(star: Star, sigma: float = 1.0) -> DataFrame:
    """Stock, sales and stockouts per region, thresholds per region and product.

    Sums per store-product merge into those per region and product, whose rows
    are a region's distinct products. Each store-product then takes the threshold
    of its region, so the records still join on their own key. The
    ``avg_..._per_product`` columns are means over records.
    """
    placed = store_product_moments(star).join(star.stores, "store_region_id")
    cells = merge_moments(placed, ["region", "product_id"])
    pairs = region_limits(placed, sigma)
    short = star.known(regionally_understocked(sigma))
    if short is None:
        settled = settle(pairs, "region-limits")
        flagged = flag_rate(star.inventory, settled, STORE_PRODUCT, sigma)
    else:
        flagged = rated(pairs, short, STORE_PRODUCT)
    stockouts = flagged.groupBy("region").agg(
        F.sum("understock_days").alias("total_stockout_days"),
        F.sum("total_days").alias("total_records"),
    )
    totals = cells.groupBy("region").agg(
        F.count("product_id").alias("distinct_products"),
        F.sum("stock_sum").alias("total_inventory"),
        F.sum("sold_sum").alias("total_units_sold"),
        F.round(ratio(F.sum("stock_sum"), F.sum("stock_rows")), 2).alias(
            "avg_inventory_per_product"
        ),
        F.round(ratio(F.sum("sold_sum"), F.sum("sold_rows")), 2).alias("avg_sales_per_product"),
    )
    rate = ratio(F.col("total_stockout_days") * 100, F.col("total_records"))
    return totals.join(stockouts, "region").withColumn(
        "stockout_rate_percentage", F.round(rate, 2)
    )


def kpi_summary(star: Star, sigma: float = 1.0) -> DataFrame:
    """Stockout rate, means and days of stock on hand per store-product."""
    profile = store_product_profile(star, sigma)
    age = mean_ratio(
        F.col("stock_sum"), F.col("stock_rows"), F.col("sold_sum"), F.col("sold_rows")
    )
    return profile.join(star.products, "product_id").select(
        *STORE_PRODUCT,
        "category",
        "total_days",
        F.col("understock_days").alias("stockout_days"),
        F.round("understock_percentage", 2).alias("stockout_rate_percentage"),
        F.col("mean_inventory").alias("avg_inventory_level"),
        F.col("mean_sales").alias("avg_daily_sales"),
        rules.inventory_age(F.col("mean_sales"), age).alias("estimated_inventory_age_days"),
    )


def seasonal_demand(star: Star) -> DataFrame:
    """Calendar months of a store-region, season and category against their mean.

    A product without a category or season belongs to no cell.
    Years are merged: a month is a month number. Records are summed per
    store-product and month before category and season join. The windows run
    over at most twelve months each. ``month_num`` is kept for ordering.
    """
    month = F.month("record_date").alias("month_num")
    months = stock_sums(star, [*STORE_PRODUCT, month], "sold", "forecast")
    cell = ["store_region_id", "seasonality", "category"]
    monthly = (
        months.join(star.products, "product_id")
        .join(star.seasonality, "product_id")
        .where(F.col("category").isNotNull() & F.col("seasonality").isNotNull())
        .groupBy(*cell, "month_num")
        .agg(F.sum("sold_sum").alias("total_sales"), F.sum("forecast_sum").alias("total_forecast"))
    )
    year = Window.partitionBy(*cell)
    sales, forecast = F.col("total_sales"), F.col("total_forecast")
    measured = monthly.withColumns(
        {
            "sales_sum": F.sum(sales).over(year),
            "sales_months": F.count(sales).over(year),
            "peak_sales": F.max(sales).over(year),
            "trough_sales": F.min(sales).over(year),
            "sales_spread": F.stddev_pop(sales).over(year),
            "forecast_sum": F.sum(forecast).over(year),
            "forecast_months": F.count(forecast).over(year),
            "peak_forecast": F.max(forecast).over(year),
            "trough_forecast": F.min(forecast).over(year),
            "forecast_spread": F.stddev_pop(forecast).over(year),
            "previous_sales": F.lag(sales).over(year.orderBy("month_num")),
        }
    )
    sales_year = F.col("sales_sum"), F.col("sales_months")
    forecast_year = F.col("forecast_sum"), F.col("forecast_months")
    sales_above = sales * whole(F.col("sales_months")) > F.col("sales_sum")
    forecast_above = forecast * whole(F.col("forecast_months")) > F.col("forecast_sum")
    first_of_month = F.make_date(F.lit(2000), F.col("month_num"), F.lit(1))
    return measured.select(
        "store_region_id",
        "category",
        "seasonality",
        F.date_format(first_of_month, "MMMM").alias("month_name"),
        "total_sales",
        "total_forecast",
        F.round(ratio(*sales_year), 2).alias("avg_monthly_sales"),
        F.round(amount_ratio(*forecast_year), 2).alias("avg_monthly_forecast"),
        "peak_sales",
        "peak_forecast",
        "trough_sales",
        "trough_forecast",
        F.round("sales_spread", 2).alias("sales_volatility"),
        F.round("forecast_spread", 2).alias("forecast_volatility"),
        F.round(F.abs(sales - forecast), 2).alias("absolute_forecast_error"),
        rules.percentage_error(sales, forecast).alias("absolute_percentage_error"),
        rules.sales_position(
            sales, F.col("peak_sales"), F.col("trough_sales"), sales_above
        ).alias("sales_performance_category"),
        rules.forecast_position(
            forecast, F.col("peak_forecast"), F.col("trough_forecast"), forecast_above
        ).alias("forecast_performance_category"),
        rules.variance_from_mean(sales, *sales_year).alias("sales_variance_from_average"),
        rules.variance_from_mean(forecast, *forecast_year).alias("forecast_variance_from_average"),
        rules.accuracy_rating(sales, forecast).alias("forecast_accuracy_rating"),
        rules.forecast_bias(sales, forecast).alias("forecast_bias"),
        rules.region_rating(sales, *sales_year).alias("region_performance_rating"),
        rules.trend_projection(sales, F.col("previous_sales")).alias(
            "trend_based_next_month_prediction"
        ),
        "month_num",
    )
