"""Sample order tables read as stock records.

A line item is one stock record: the supplier's nation is the store, its region
the region, the part's brand the product. Several lines of a store-region,
product and day add up to that day's record.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflight.operators import normalize
from shelflight.schemas import STAGING, TABLES
from shelflight.star import Star
from shelflight.storage import settle

# The columns read, with their types in the files; naming them spares a pass
# over the footers to infer the schema.
_COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
}

# Staging columns over the joined tables. Rates are taken in whole percent, so
# amounts are products of whole numbers and one exact factor.
_DISCOUNT = "cast(rint(l_discount * 100) as int)"
_TAX = "cast(rint(l_tax * 100) as int)"
_SOLD = "cast(l_quantity as int)"
_VALUES = {
    "record_date": "cast(l_shipdate as date)",
    "store_id": "store_id",
    "product_id": "p_brand",
    "category": "p_type",
    "region": "region",
    "store_region_id": "store_region_id",
    "inventory_level": f"{_SOLD} + p_size",
    "units_sold": _SOLD,
    "units_ordered": "l_linenumber",
    "demand_forecast": f"greatest({_SOLD} + 2 * (p_size - 25), 0)",
    "price": "p_size * 0.75",
    "discount": _DISCOUNT,
    "weather_condition": "o_orderpriority",
    "holiday_promotion": f"{_DISCOUNT} >= 5",
    "competitor_pricing": f"p_size * (75 + {_TAX} - {_DISCOUNT}) * 0.01",
    "seasonality": "element_at(array('Winter', 'Spring', 'Summer', 'Autumn'), "
    "cast(l_orderkey % 4 as int) + 1)",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their part and place.

    Nations and regions do not grow with the data and are joined to each other
    first. Parts and suppliers do; each joins on its own, so that every join is
    planned from the size of a file: broadcast while small, else shuffled.
    """
    table = partial(_table, spark, folder)
    places = (
        table("nation")
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "n_nationkey",
            F.col("n_name").alias("store_id"),
            F.col("r_name").alias("region"),
            F.concat("n_name", F.lit("_"), "r_name").alias("store_region_id"),
        )
    )
    return (
        table("lineitem")
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    )


def staging(spark: SparkSession, folder: str, weather: bool = True) -> DataFrame:
    """One staging row per line item.

    The weather comes from the order and costs the join of the two largest
    tables. Callers that read no weather leave it out; it is then NULL. A line
    without its order keeps a NULL weather as well.
    """
    lines = _lines(spark, folder)
    values = dict(_VALUES)
    if weather:
        orders = _table(spark, folder, "orders")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    else:
        values["weather_condition"] = "cast(null as string)"
    return lines.selectExpr(*[f"{text} as {name}" for name, text in values.items()]).to(STAGING)


_DAY = ["record_date", "store_region_id", "product_id"]
_ADDED = ["inventory_level", "units_sold", "units_ordered", "demand_forecast"]
_HIGHEST = ["price", "discount", "competitor_pricing"]
MEASURES = (*_ADDED, *_HIGHEST)


def _measures(names: Iterable[str]) -> list[Column]:
    return [
        (F.sum(name) if name in _ADDED else F.max(name)).alias(name) for name in MEASURES if name in names
    ]


def daily_records(rows: DataFrame) -> DataFrame:
    """Lines of a store-region, product and day as one record: amounts add up,
    the highest price, discount and competitor price stand."""
    return rows.groupBy(*_DAY).agg(*_measures(MEASURES))


# Loads of the sample: up to this day, and again from some days before it.
_CUT = "1995-06-17"
_OVERLAP = 30


def daily_staging(spark: SparkSession, folder: str) -> DataFrame:
    """Staging rows of which each store-region, product and day has one."""
    mood = F.min(F.struct("weather_condition", "holiday_promotion")).alias("mood")
    texts = ["store_id", "region", "category", "seasonality"]
    daily = staging(spark, folder).groupBy(*_DAY).agg(
        *_measures(MEASURES), *[F.min(name).alias(name) for name in texts], mood
    )
    return daily.select("*", "mood.*").to(STAGING)


def two_loads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The daily rows in two parts; the second repeats days of the first with other values."""
    daily = settle(daily_staging(spark, folder), "daily-staging")
    date, cut = F.col("record_date"), F.to_date(F.lit(_CUT))
    old = date < cut
    changed = {
        "category": F.concat("category", F.lit(" again")),
        "seasonality": F.lit("Never"),
        "weather_condition": F.lit("0-NONE"),
        "inventory_level": F.col("inventory_level") + 1,
        "price": F.col("price") + 1,
    }
    later = daily.where(date >= F.date_sub(cut, _OVERLAP)).withColumns(
        {name: F.when(old, value).otherwise(F.col(name)) for name, value in changed.items()}
    )
    return daily.where(old), later.to(STAGING)


# What the dimensions are cut from: the first date of each mix of these columns.
_SIGHTING = ["product_id", "category", "seasonality", "store_region_id"]
_PLACE = ["store_region_id", "store_id", "region"]


def _one_pass(rows: DataFrame, measures: tuple[str, ...], dims: tuple[str, ...]):
    """Daily records, and what the dimensions need, from one read of the line items.

    The groupings share the joins of the base: each row meets them once and is
    counted in every grouping, map-side.
    """
    sets = [_DAY]
    if {"products", "seasonality"} & set(dims):
        sets.append(_SIGHTING)
    if "stores" in dims:
        sets.append(_PLACE)
    names = list(dict.fromkeys(name for columns in sets for name in columns))
    part = F.when(F.grouping("record_date") == 0, "daily")
    if _SIGHTING in sets:
        part = part.when(F.grouping("category") == 0, "sightings")
    grouped = rows.groupingSets(sets, *names).agg(
        *_measures(measures),
        F.min(F.col("record_date")).alias("first_date"),
        part.otherwise("places").alias("part"),
    )
    settled = settle(grouped, "base-records", by="part")

    def cut(columns: list[str], name: str) -> DataFrame:
        date = F.col("first_date").alias("record_date")
        return settled.where(F.col("part") == name).select(*columns, date)

    daily = settled.where("part = 'daily'").select(*_DAY, *measures)
    return daily, cut(_SIGHTING, "sightings") if _SIGHTING in sets else rows, (
        cut(_PLACE, "places") if _PLACE in sets else rows
    )


def star(
    spark: SparkSession, folder: str, settled: tuple[str, ...] = (), dims: tuple[str, ...] = ()
) -> Star:
    """The normalised tables of the sample, each planned when first read.

    ``settled`` names the measures of a report that reads the daily records more
    than once, and ``dims`` the dimensions it joins. They are written to the shared
    folder first, so the line items are joined and summed in one pass, and all are
    read from the tables written. The facts then hold these measures only.
    """
    rows = staging(spark, folder, weather=False)
    sightings = places = rows
    if settled and dims:
        daily, sightings, places = _one_pass(rows, settled, dims)
    elif settled:
        daily = settle(daily_records(rows).select(*_DAY, *settled), "daily-records")
    else:
        daily = daily_records(rows)

    def fact(name: str) -> DataFrame:
        declared = [f for f in TABLES[name].fields if f.name in daily.columns]
        return daily.to(T.StructType(declared))

    return Star(
        stores=lambda: normalize.stores(places),
        products=lambda: normalize.products(sightings),
        seasonality=lambda: normalize.seasonality(sightings),
        inventory=lambda: fact("inventory"),
        pricing=lambda: fact("pricing"),
        store_events=lambda: normalize.store_events(staging(spark, folder)),
    )


def with_gaps(star: Star, sales: bool = True) -> Star:
    """The sample with NULLs by rule, which it does not have of itself.

    With ``sales``, none where they are a multiple of seven, nor on any day of Brand#11 in one store;
    no category for Brand#12 and no season for Brand#13.
    """
    sold, product = F.col("units_sold"), F.col("product_id")
    one = (product == "Brand#11") & (F.col("store_region_id") == "NATION_21_AMERICA")
    no_sales = (sold % 7 == 0) | one

    def without(table: DataFrame, column: str, where: Column) -> DataFrame:
        return table.withColumn(column, F.when(~where, F.col(column)))

    return Star(
        products=lambda: without(star.products, "category", product == "Brand#12"),
        seasonality=lambda: without(star.seasonality, "seasonality", product == "Brand#13"),
        inventory=lambda: without(star.inventory, "units_sold", no_sales)
        if sales
        else star.inventory,
    )


# Field texts of a raw line over staging columns; quotes inside quotes are doubled.
_LINE = {
    "record_date": "date_format(record_date, 'yyyy-M-d')",
    "store_id": "store_id",
    "product_id": "product_id",
    "category": "concat('\"Toys \"\"', category, '\"\", big\"')",
    "region": "concat('\"', region, '\"')",
    "inventory_level": "inventory_level",
    "units_sold": "units_sold",
    "units_ordered": "units_ordered",
    "demand_forecast": "demand_forecast",
    "price": "price",
    "discount": "discount",
    "weather_condition": "case units_ordered when 1 then '\\\\N' when 2 then '' else '\"Fair, mild\"' end",
    "holiday_promotion": "cast(holiday_promotion as int)",
    "competitor_pricing": "competitor_pricing",
    "seasonality": "seasonality",
}
# By units sold: what is wrong with a line.
_WRONG = {
    3: ("record_date", "'soon'"),
    5: ("inventory_level", "''"),
    7: ("holiday_promotion", "'2'"),
    9: ("price", "'cheap'"),
}
_SHORT = 11
# Texts with line breaks, every third line.
_BREAKS = {
    "category": "if(units_sold % 3 = 0, concat('\"Toys \n\"\"', category, '\"\",\n\n big\"'), {})",
    "weather_condition": "if(units_sold % 3 = 0, '\"Fair\r\nmild\n\"', {})",
}


def write_raw_lines(
    spark: SparkSession, folder: str, path: str, wrong: bool = False, breaks: bool = False
) -> None:
    """The sample as plain text lines below a header in each file.

    Some of them are wrong, or have line breaks inside quotes, if asked.
    """
    fields = dict(_LINE)
    if breaks:
        fields |= {name: text.format(fields[name]) for name, text in _BREAKS.items()}
    if wrong:
        for sold, (name, text) in _WRONG.items():
            fields[name] = f"if(units_sold = {sold}, {text}, cast({fields[name]} as string))"
    rows = staging(spark, folder, weather=False).selectExpr(
        *[f"cast({text} as string) as {name}" for name, text in fields.items()]
    )
    line = F.concat_ws(",", *fields)
    if wrong:
        names = list(fields)[:-3]
        line = F.when(F.col("units_sold") == str(_SHORT), F.concat_ws(",", *names)).otherwise(line)
    # Ids count from zero, in the lower 33 bits, in each partition and so in each file.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.lit(",".join(fields) + "\n")
    text = rows.select(line.alias("value"), first.alias("first"))
    text.select(
        F.concat(F.when(F.col("first"), header).otherwise(""), F.col("value")).alias("value")
    ).write.text(path)
