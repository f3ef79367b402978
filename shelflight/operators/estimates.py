"""Estimates from sketches that loads keep and that unite without the records.

Opt-in: the reports are exact. A sketch is made of one load's records and stored; those of
all loads are united for an estimate of the whole, so a new load reads its own records
only. A sketch has a bounded size, whatever it has seen, and combines map-side.

Bounds. A median estimate lies, among the known sales of its group, within ``RANK_ERROR``
of the half; groups of fewer than ``MEDIAN_K`` known sales are exact to the rank. A count
of products is within ``COUNT_ERROR`` of the true one. Both hold with the confidence of their
sketches (99 % for the rank, three deviations for the count), not for certain. Quantile
sketches draw at random: a run again may give another estimate within the bound.

NULLs are not seen by a sketch: a median is that of the known sales, NULL without any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.schemas import STORE_PRODUCT

# Items a quantile sketch keeps on its highest levels, and the error of a rank that follows.
MEDIAN_K = 400
RANK_ERROR = 0.015
# Registers of a distinct-count sketch as a power of two; three times 1.04 / sqrt(4096).
COUNT_LOG_K = 12
COUNT_ERROR = 0.05


# ---- medians per store-product ---------------------------------------------------


def median_sketches(inventory: DataFrame) -> DataFrame:
    """Per store-product the known sales and a quantile sketch of them."""
    sold = F.col("units_sold").cast("long")
    return inventory.groupBy(*STORE_PRODUCT).agg(
        F.count(sold).alias("known"),
        F.kll_sketch_agg_bigint(sold, F.lit(MEDIAN_K)).alias("sketch"),
    )


def united_medians(sketches: DataFrame) -> DataFrame:
    """The sketches of several loads as one per store-product."""
    return sketches.groupBy(*STORE_PRODUCT).agg(
        F.sum("known").alias("known"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )


def estimated_medians(sketches: DataFrame) -> DataFrame:
    """``median_estimate`` of each store-product: a value that was sold on some day."""
    middle = F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5))
    return sketches.select(
        *STORE_PRODUCT, "known", F.when(F.col("known") > 0, middle).alias("median_estimate")
    )


def medians_checked(estimates: DataFrame, inventory: DataFrame) -> DataFrame:
    """Whether each estimate of settled ``estimates`` is within its bound, from the records.

    The ranks an estimate takes up, from the records below it to those not above it, must
    come within ``RANK_ERROR`` of the half, or within one record.
    """
    sold, guess = F.col("units_sold"), F.col("median_estimate")
    seen = (
        inventory.join(estimates, STORE_PRODUCT)
        .groupBy(*STORE_PRODUCT, "known", "median_estimate")
        .agg(
            F.count_if(sold < guess).alias("below"),
            F.count_if(sold <= guess).alias("upto"),
            F.count(sold).alias("counted"),
        )
    )
    known = F.col("counted")
    slack = F.greatest(known * RANK_ERROR, F.lit(1.0))
    close = (F.col("below") <= known / 2 + slack) & (F.col("upto") >= known / 2 - slack)
    within = F.when(known == 0, guess.isNull()).otherwise(guess.isNotNull() & close)
    return seen.select(*STORE_PRODUCT, "known", (within & (known == F.col("known"))).alias("within_bound"))


# ---- products per region ---------------------------------------------------------


def product_sketches(inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Per region a sketch of the different products it has records of.

    Products are sketched per store-region first, so the records meet no other table.
    """
    places = inventory.groupBy("store_region_id").agg(
        F.hll_sketch_agg("product_id", F.lit(COUNT_LOG_K)).alias("sketch")
    )
    return united_products(places.join(stores, "store_region_id").select("region", "sketch"))


def united_products(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("region").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_products(sketches: DataFrame) -> DataFrame:
    return sketches.select("region", F.hll_sketch_estimate("sketch").alias("products_estimate"))


def products_checked(estimates: DataFrame, inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """The exact number of products per region, and whether the estimate is within its bound."""
    offered = inventory.select("store_region_id", "product_id").distinct()
    exact = (
        offered.join(stores, "store_region_id")
        .select("region", "product_id")
        .distinct()
        .groupBy("region")
        .agg(F.count("product_id").alias("distinct_products"))
    )
    gap = F.abs(F.col("products_estimate") - F.col("distinct_products"))
    within = F.coalesce(gap <= F.col("distinct_products") * COUNT_ERROR, F.lit(False))
    return exact.join(estimates, "region", "left").select(
        "region", "distinct_products", within.alias("within_bound")
    )
