"""Sums of both facts per group, from the records or from a pass that all reports share.

A report asks for sums by name. On a plain star they are taken from the records,
and only those asked for are computed. On a star that ``plans.gathering`` has
prepared they are added up from its cells: one row per store-product and month,
which hold every sum that any report asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.operators.profile import group_moments
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import RANGE, Star

# In a star that knows it: sums per store-product and month, dated the first of it.
CELLS = "cells"

# What a report calls a measure, and the fact's column behind it.
STOCK = {"stock": "inventory_level", "sold": "units_sold", "forecast": "demand_forecast"}
PRICES = {"price": "price", "competitor": "competitor_pricing", "discount": "discount"}


def _sums(columns: dict[str, str | Column], prefix: str = "") -> list[Column]:
    found = []
    for name, column in columns.items():
        found += [
            F.sum(column).alias(f"{prefix}{name}_sum"),
            F.count(column).alias(f"{prefix}{name}_rows"),
        ]
    return found


def merge_cells(cells: DataFrame, keys: list[str | Column], rows: str) -> DataFrame:
    """Sums per group from those of the cells; groups without any of ``rows`` have no row.

    A sum keeps the type it has in a cell, which is that of a sum over records, so
    reports have the same columns from either source.
    """
    kept = [f for f in cells.schema if f.name not in (*STORE_PRODUCT, "record_date")]
    added = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in kept]
    return cells.groupBy(*keys).agg(*added).where(F.col(rows) > 0)


def stock_sums(star: Star, keys: list[str | Column], *names: str) -> DataFrame:
    """``<name>_sum`` and ``<name>_rows`` of the stock records, per group.

    Keys may be columns of a store-product, and of the date those that are the same
    for all days of a month.
    """
    if (cells := star.known(CELLS)) is not None:
        return merge_cells(cells, keys, "total_days")
    return star.inventory.groupBy(*keys).agg(*_sums({n: STOCK[n] for n in names}))


def price_sums(star: Star, keys: list[str | Column], *names: str) -> DataFrame:
    """The same of all price records, with or without a stock record."""
    if (cells := star.known(CELLS)) is not None:
        return merge_cells(cells, keys, "price_records")
    return star.pricing.groupBy(*keys).agg(*_sums({n: PRICES[n] for n in names}))


def priced_sums(star: Star, keys: list[str | Column], *names: str) -> DataFrame:
    """``priced_<name>_sum`` and ``..._rows`` of the stock records that have a price record."""
    if (cells := star.known(CELLS)) is not None:
        return merge_cells(cells, keys, "priced_rows")
    measures = {n: column for n, column in {**STOCK, **PRICES}.items() if n in names}
    stock = [column for n, column in measures.items() if n in STOCK]
    prices = [column for n, column in measures.items() if n in PRICES]
    records = joined_facts(star, stock, prices, "inner")
    return records.groupBy(*keys).agg(*_sums(measures, "priced_"))


def joined_facts(star: Star, stock: list[str], prices: list[str], how: str) -> DataFrame:
    """Stock records with their price record, joined on the full key of both facts.

    ``stocked`` and ``priced`` tell which of the two a row has. Aligned facts join
    range by range, without an exchange of either.
    """
    keys = ["record_date", *STORE_PRODUCT]
    left, right = star.inventory, star.pricing
    if RANGE in left.columns and RANGE in right.columns:
        keys, right = [RANGE, *keys], right.hint("merge")
    left = left.select(*keys, *stock, F.lit(True).alias("stocked"))
    return left.join(right.select(*keys, *prices, F.lit(True).alias("priced")), keys, how)


def fact_cells(star: Star) -> DataFrame:
    """Every sum of both facts per store-product and month, each fact read once.

    The facts meet in a full outer join on their whole key. The sums combine
    map-side; a store-product has one row a month, however many records.
    """
    records = joined_facts(star, list(STOCK.values()), list(PRICES.values()), "outer")
    both = F.col("stocked") & F.col("priced")
    matched = {n: F.when(both, F.col(c)) for n, c in {**STOCK, **PRICES}.items()}
    forecast = {"forecast": STOCK["forecast"]}
    months = records.withColumn("record_date", F.trunc("record_date", "month"))
    cells = group_moments(
        months,
        [*STORE_PRODUCT, "record_date"],
        F.count("stocked").alias("stock_records"),
        F.count("priced").alias("price_records"),
        F.count_if(both).alias("priced_rows"),
        *_sums(forecast),
        *_sums(PRICES),
        *_sums(matched, "priced_"),
    )
    # A price record alone is no day of stock.
    return cells.withColumn("total_days", F.col("stock_records")).drop("stock_records")
