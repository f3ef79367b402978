"""Staging rows to dimensions and facts.

Where several rows share a primary key the first one wins, in an order written
down here: the source of a row (file, split, task) never decides. Rows whose
key is NULL cannot be joined and stay out of every table; the quality jobs
count them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.schemas import PRIMARY_KEYS, TABLES
from shelflight.star import Star


def first_wins(
    rows: DataFrame, keys: list[str], values: list[str], order: list[str] | None = None
) -> DataFrame:
    """Keep per key the values of the first row by ``order``, then by the values.

    Ranking by several columns is a sort-based aggregate. Callers whose keys
    repeat often collapse the rows with a hash aggregate first.
    """
    ranking = [*(order or []), *values]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*ranking)).alias("first"))
    return first.select(*keys, *[F.col("first")[name].alias(name) for name in values])


def _keyed(staging: DataFrame, table: str) -> DataFrame:
    for key in PRIMARY_KEYS[table]:
        staging = staging.where(F.col(key).isNotNull())
    return staging


def declared(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a table in declared order and type."""
    return rows.to(TABLES[table])


def stores(staging: DataFrame) -> DataFrame:
    seen = (
        _keyed(staging, "stores")
        .groupBy("store_region_id", "store_id", "region")
        .agg(F.min("record_date").alias("record_date"))
    )
    values = ["store_id", "region"]
    return declared(first_wins(seen, PRIMARY_KEYS["stores"], values, ["record_date"]), "stores")


def sightings(staging: DataFrame) -> DataFrame:
    """First date of every mix of product, category, season and store-region.

    The minimum of a date combines map-side, so a few rows per product are left
    to rank. Both product dimensions start here; a report that joins both reads
    one shuffle.
    """
    return (
        _keyed(staging, "products")
        .groupBy("product_id", "category", "seasonality", "store_region_id")
        .agg(F.min("record_date").alias("record_date"))
    )


def _product_dimension(staging: DataFrame, table: str, value: str) -> DataFrame:
    order = ["record_date", "store_region_id"]
    return declared(first_wins(sightings(staging), ["product_id"], [value], order), table)


def products(staging: DataFrame) -> DataFrame:
    return _product_dimension(staging, "products", "category")


def seasonality(staging: DataFrame) -> DataFrame:
    return _product_dimension(staging, "seasonality", "seasonality")


def inventory(staging: DataFrame) -> DataFrame:
    """A plain projection: a repeated key is an error, found by the quality jobs."""
    return declared(_keyed(staging, "inventory"), "inventory")


def pricing(staging: DataFrame) -> DataFrame:
    """Keys are close to unique here, so there is nothing to collapse beforehand."""
    values = ["price", "discount", "competitor_pricing"]
    rows = _keyed(staging, "pricing")
    return declared(first_wins(rows, PRIMARY_KEYS["pricing"], values), "pricing")


def store_events(staging: DataFrame) -> DataFrame:
    """By weather, then by the holiday flag, whose minimum combines map-side."""
    keys = PRIMARY_KEYS["store_events"]
    seen = (
        _keyed(staging, "store_events")
        .groupBy(*keys, "weather_condition")
        .agg(F.min("holiday_promotion").alias("holiday_promotion"))
    )
    values = ["weather_condition", "holiday_promotion"]
    return declared(first_wins(seen, keys, values), "store_events")


def star(staging: DataFrame, unique: bool = False) -> Star:
    """All six tables of a staging table.

    ``unique``: the inventory key has been checked. Prices have the same key, so none
    repeats either, and both facts are projections.
    """
    priced = declared(staging, "pricing") if unique else pricing(staging)
    return Star(
        stores=stores(staging),
        products=products(staging),
        seasonality=seasonality(staging),
        inventory=inventory(staging),
        pricing=priced,
        store_events=store_events(staging),
    )
