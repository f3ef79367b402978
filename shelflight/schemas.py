"""Declared schemas, keys and limits of the stock-record model."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(10, 2)
_PERCENT = T.DecimalType(5, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# The raw file, in file order. The holiday flag is written as 0/1, which the CSV
# reader does not take for a boolean, so it is read as a number and cast after.
CSV_RECORD = _struct(
    ("record_date", T.DateType()),
    ("store_id", T.StringType()),
    ("product_id", T.StringType()),
    ("category", T.StringType()),
    ("region", T.StringType()),
    ("inventory_level", T.IntegerType()),
    ("units_sold", T.IntegerType()),
    ("units_ordered", T.IntegerType()),
    ("demand_forecast", _MONEY),
    ("price", _MONEY),
    ("discount", _PERCENT),
    ("weather_condition", T.StringType()),
    ("holiday_promotion", T.IntegerType()),
    ("competitor_pricing", _MONEY),
    ("seasonality", T.StringType()),
)

STAGING = _struct(
    ("record_date", T.DateType()),
    ("store_id", T.StringType()),
    ("product_id", T.StringType()),
    ("category", T.StringType()),
    ("region", T.StringType()),
    ("store_region_id", T.StringType()),
    ("inventory_level", T.IntegerType()),
    ("units_sold", T.IntegerType()),
    ("units_ordered", T.IntegerType()),
    ("demand_forecast", _MONEY),
    ("price", _MONEY),
    ("discount", _PERCENT),
    ("weather_condition", T.StringType()),
    ("holiday_promotion", T.BooleanType()),
    ("competitor_pricing", _MONEY),
    ("seasonality", T.StringType()),
)

STORES = _struct(
    ("store_region_id", T.StringType()),
    ("store_id", T.StringType()),
    ("region", T.StringType()),
)

PRODUCTS = _struct(("product_id", T.StringType()), ("category", T.StringType()))

SEASONALITY = _struct(("product_id", T.StringType()), ("seasonality", T.StringType()))

INVENTORY = _struct(
    ("record_date", T.DateType()),
    ("store_region_id", T.StringType()),
    ("product_id", T.StringType()),
    ("inventory_level", T.IntegerType()),
    ("units_sold", T.IntegerType()),
    ("units_ordered", T.IntegerType()),
    ("demand_forecast", _MONEY),
)

PRICING = _struct(
    ("store_region_id", T.StringType()),
    ("product_id", T.StringType()),
    ("record_date", T.DateType()),
    ("price", _MONEY),
    ("discount", _PERCENT),
    ("competitor_pricing", _MONEY),
)

STORE_EVENTS = _struct(
    ("store_region_id", T.StringType()),
    ("record_date", T.DateType()),
    ("weather_condition", T.StringType()),
    ("holiday_promotion", T.BooleanType()),
)

TABLES: dict[str, T.StructType] = {
    "stores": STORES,
    "products": PRODUCTS,
    "seasonality": SEASONALITY,
    "inventory": INVENTORY,
    "pricing": PRICING,
    "store_events": STORE_EVENTS,
}

# Records of a store-product by the stock left after the day's sales, NULL included.
NET_COUNTS = _struct(
    ("store_region_id", T.StringType()),
    ("product_id", T.StringType()),
    ("net", T.LongType()),
    ("days", T.LongType()),
)

PRIMARY_KEYS: dict[str, list[str]] = {
    "stores": ["store_region_id"],
    "products": ["product_id"],
    "seasonality": ["product_id"],
    "inventory": ["record_date", "store_region_id", "product_id"],
    "pricing": ["store_region_id", "product_id", "record_date"],
    "store_events": ["store_region_id", "record_date"],
}

# (child table, parent table, shared key column)
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("inventory", "stores", "store_region_id"),
    ("inventory", "products", "product_id"),
    ("pricing", "stores", "store_region_id"),
    ("pricing", "products", "product_id"),
    ("store_events", "stores", "store_region_id"),
    ("seasonality", "products", "product_id"),
]

# Longest text each staging column may hold.
TEXT_LIMITS: dict[str, int] = {
    "store_id": 10,
    "product_id": 10,
    "category": 100,
    "region": 100,
    "store_region_id": 110,
    "weather_condition": 50,
    "seasonality": 50,
}

# Most digits before the point each staging amount may have.
DIGIT_LIMITS: dict[str, int] = {
    "demand_forecast": 8,
    "price": 8,
    "discount": 3,
    "competitor_pricing": 8,
}

STORE_PRODUCT = ["store_region_id", "product_id"]
