"""Reports on stock health: sales profile, understock, movement, overstock, stockouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import rules
from shelflight.functions.numeric import ratio, scaled_spread
from shelflight.operators.profile import (
    LIMITS,
    counted_profile,
    flag_below,
    net_stock,
    store_product_moments,
    store_product_profile,
    sum_of_squares,
    with_threshold,
)
from shelflight.operators.selection import RANGES, middle_values
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import Star
from shelflight.storage import settle


# Stands for a NULL while values are ordered: below every 32-bit number, and a
# midpoint with it can be told from one without.
_BELOW_ALL = -float(1 << 40)

# Name under which a star knows the medians of its store-products.
MEDIANS = "median sales"


def median(value: Column) -> Column:
    """Median of all records of a group: NULLs sort first and take part in the ranks.

    The mean of the two middle records is that of those that are not NULL. One
    aggregate holds a count per distinct value, not the records.
    """
    found = F.percentile(F.coalesce(value.cast("double"), F.lit(_BELOW_ALL)), 0.5)
    return (
        F.when(found == _BELOW_ALL, F.lit(None))
        .when(found < _BELOW_ALL / 4, 2 * found - _BELOW_ALL)
        .otherwise(found)
    )


def sales_profile(star: Star) -> DataFrame:
    """Mean, exact median and population deviation of daily sales, per store-product.

    Every store-product has a row, also one whose sales are all NULL.
    """
    if (medians := star.known(MEDIANS)) is not None:
        rows, total = F.col("sold_rows"), F.col("sold_sum")
        spread = scaled_spread(rows, total, F.col("sold_squares"))
        return store_product_moments(star).join(medians, STORE_PRODUCT).select(
            *STORE_PRODUCT,
            ratio(total, rows).alias("avg_sales"),
            "median_sales",
            F.round(ratio(spread, rows), 6).alias("stddev_sales"),
        )
    sold = F.col("units_sold")
    spread = scaled_spread(F.count(sold), F.sum(sold), sum_of_squares(sold))
    return star.inventory.groupBy(*STORE_PRODUCT).agg(
        ratio(F.sum(sold), F.count(sold)).alias("avg_sales"),
        median(sold).alias("median_sales"),
        F.round(ratio(spread, F.count(sold)), 6).alias("stddev_sales"),
    )


def sales_profile_selected(star: Star, ranges: int = RANGES) -> DataFrame:
    """The same report where store-products are too large for a count per distinct value.

    The first pass finds means, deviations and the span of the sales; further ones
    narrow down the median range by range, see ``operators.selection``. ``ranges``
    bounds what a task holds of a store-product.
    """
    sold = F.col("units_sold")
    spread = scaled_spread(F.count(sold), F.sum(sold), sum_of_squares(sold))
    limits = star.inventory.groupBy(*STORE_PRODUCT).agg(
        ratio(F.sum(sold), F.count(sold)).alias("avg_sales"),
        F.round(ratio(spread, F.count(sold)), 6).alias("stddev_sales"),
        F.count("*").alias("rows"),
        F.count(sold).alias("known"),
        F.min(sold).alias("least"),
        F.max(sold).alias("greatest"),
    )
    limits = settle(limits, "sales-limits")
    middle = middle_values(star.inventory, STORE_PRODUCT, sold, limits, ranges)
    lower, upper = F.col("lower"), F.col("upper")
    # NULLs sort first: where one of the two is NULL, it is the lower one.
    found = F.coalesce((lower + upper).cast("double") / 2, upper.cast("double"))
    return limits.join(middle, STORE_PRODUCT).select(
        *STORE_PRODUCT, "avg_sales", found.alias("median_sales"), "stddev_sales"
    )


def stock_level(star: Star, sigma: float = 1.0) -> DataFrame:
    """Every record's net stock against the threshold of its store-product.

    The category joins the thresholds, of which there is one per store-product,
    so the fact takes part in one join only.
    """
    limits = (
        with_threshold(store_product_moments(star), sigma)
        .join(star.products, "product_id")
        .select(*STORE_PRODUCT, *LIMITS, "threshold", "category")
    )
    records = star.inventory.select("record_date", *STORE_PRODUCT, net_stock().alias("net"))
    flagged = flag_below(records.join(settle(limits, "thresholds"), STORE_PRODUCT), sigma)
    return flagged.select(
        "record_date",
        *STORE_PRODUCT,
        "category",
        F.col("net").alias("stock_level"),
        F.round("threshold", 6).alias("threshold"),
        rules.stock_status(F.col("below")).alias("stock_status"),
    )


def movement(star: Star, sigma: float = 1.3, percent: int = 10) -> DataFrame:
    """Fast or slow, by the share of understocked days."""
    return _movement(store_product_profile(star, sigma), percent)


def movement_from_counts(counts: DataFrame, sigma: float = 1.3, percent: int = 10) -> DataFrame:
    """The same from the counts that loads keep up to date; no record is read."""
    return _movement(counted_profile(counts, sigma), percent)


def _movement(profile: DataFrame, percent: int) -> DataFrame:
    return profile.select(
        *STORE_PRODUCT,
        "understock_days",
        "total_days",
        F.round("understock_percentage", 2).alias("understock_percentage"),
        rules.movement(F.col("understock_days"), F.col("total_days"), percent).alias(
            "movement_type"
        ),
    )


def overstock(star: Star, factor: int = 2) -> DataFrame:
    """Records whose stock is more than ``factor`` times the forecast."""
    stock, forecast = F.col("inventory_level"), F.col("demand_forecast")
    return star.inventory.where(stock > forecast * factor).select(
        *STORE_PRODUCT,
        "inventory_level",
        "demand_forecast",
        (stock - forecast).alias("overstock_amount"),
    )


def stockout_by_store(star: Star, sigma: float = 1.0) -> DataFrame:
    """Stockout rate per store-region against the unweighted mean of those rates.

    ``total_days`` counts records, so a day counts once per product. Rates are
    decimals: their mean does not depend on the order in which they arrive.
    """
    profile = store_product_profile(star, sigma)
    hundredfold = (F.sum("understock_days") * 100).cast("decimal(20,0)")
    stores = profile.groupBy("store_region_id").agg(
        F.sum("understock_days").alias("stockout_days"),
        F.sum("total_days").alias("total_days"),
        (hundredfold / F.sum("total_days").cast("decimal(20,0)")).alias("rate"),
    )
    benchmark = stores.agg(F.avg("rate")).scalar()
    return stores.select(
        "store_region_id",
        "stockout_days",
        "total_days",
        F.round(F.col("rate").cast("double"), 2).alias("stockout_rate_percentage"),
        rules.store_performance(F.col("rate"), benchmark).alias("region_performance"),
    )
