"""Tables whose files are listed with what they hold, so that a reader opens few of them.

The listing has a row for each file: its rows, and the least and greatest value of columns
or expressions over columns. Footers hold the bounds of single columns only and must be
opened to be read; the listing also bounds an expression over several, and is one small
table. Three layouts are built on it:

* a fact in Z-order of (store-region, product), sliced by either through few files;
* the inventory by how far stock exceeds its forecast, for the overstock report;
* a report in its presented order, of which a reader takes a page.

A listing has a line for each file, as the engine's own file index on the driver does. A
reader takes the lines it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelflight.plans.reports import Report
from shelflight.schemas import STORE_PRODUCT, TABLES
from shelflight.star import Star
from shelflight.storage import settle

# Rows of a file, about.
FILE_ROWS = 2_000_000
_FILE = "file_name"
_FACTS = ("inventory", "pricing")


# ---- listings ------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, bounds: dict[str, Column]) -> None:
    """Write the listing of the parquet files below ``path``/rows to ``path``/listing.

    ``bounds`` names the expressions that are bounded. NULLs have no part in a bound.
    """
    ends = [
        end(value).alias(f"{side}_{name}")
        for name, value in bounds.items()
        for side, end in (("least", F.min), ("greatest", F.max))
    ]
    rows = spark.read.parquet(f"{path}/rows")
    listing = rows.groupBy(F.col("_metadata.file_name").alias(_FILE)).agg(
        F.count("*").alias("rows"), *ends
    )
    listing.coalesce(1).write.parquet(f"{path}/listing")


def listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/listing")


def chosen_files(spark: SparkSession, path: str, wanted: Column) -> list[str]:
    """The files whose line in the listing satisfies ``wanted``."""
    names = listing(spark, path).where(wanted).select(_FILE).collect()
    return sorted(f"{path}/rows/{row[_FILE]}" for row in names)


def read_files(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """Rows of the files whose line in the listing satisfies ``wanted``; others are not opened.

    Without any such file, no rows.
    """
    schema = spark.read.parquet(f"{path}/rows").schema
    files = chosen_files(spark, path, wanted)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)


def may_hold(name: str, value) -> Column:
    """Whether a file can have rows in which ``name`` equals ``value``."""
    return F.lit(value).between(F.col(f"least_{name}"), F.col(f"greatest_{name}"))


# ---- Z-order -------------------------------------------------------------------

# Steps of a code: values of a column are told apart down to 1/65,536 of the rows.
_BITS = 16


def _spread(code: Column) -> Column:
    """The bits of a code, each followed by a free one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        code = code.bitwiseOR(F.shiftleft(code, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return code


def column_codes(table: DataFrame, column: str) -> DataFrame:
    """(column, code): the share of rows below each value, in steps of 1/65,536, spread.

    Shares rather than ranks: equal steps of a code then hold about equally many rows. The
    values are sorted by ranges; no task holds more than a range or a line for each.
    """
    counted = table.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    counts = settle(dealt, "value-counts")
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(
        "part",
        (F.sum("size").over(every) - F.col("size")).alias("start"),
        F.sum("size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(column)
    before = F.sum("n").over(inside) - F.col("n") + F.col("start")
    codes = counts.join(starts, "part").select(
        column, F.floor(before * (1 << _BITS) / F.col("total")).cast("long").alias("code")
    )
    return settle(codes.select(column, _spread(F.col("code")).alias("code")), "value-codes")


def in_z_order(table: DataFrame, first: str, second: str, then: list[str], files: int) -> DataFrame:
    """Rows dealt to ``files`` partitions in the interleaved order of two columns.

    Any of the two bounds a partition about equally well. Rows of equal codes are cut by
    ``then``, so one pair of values that is very frequent spans several partitions. Rows
    without a value come first.
    """
    for column in (first, second):
        codes = column_codes(table, column).withColumnRenamed("code", f"__{column}")
        table = table.join(codes, column, "left")
    high, low = (F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in (first, second))
    placed = table.withColumn("__z", F.shiftleft(high, 1).bitwiseOR(low))
    dealt = placed.repartitionByRange(files, "__z", first, second, *then)
    return dealt.sortWithinPartitions(first, second, *then).drop("__z", f"__{first}", f"__{second}")


def save_sliceable(star: Star, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Save the star so that slices by product or by store-region read few files."""
    spark = star.inventory.sparkSession
    for name in TABLES:
        table = star.table(name)
        if name not in _FACTS:
            table.write.parquet(f"{folder}/{name}")
            continue
        path = f"{folder}/{name}"
        files = max(1, -(-table.count() // file_rows))
        ordered = in_z_order(table, *STORE_PRODUCT, then=["record_date"], files=files)
        ordered.select(*table.columns).write.parquet(f"{path}/rows")
        list_files(spark, path, {c: F.col(c) for c in (*STORE_PRODUCT, "record_date")})


def read_slice(
    spark: SparkSession,
    folder: str,
    product_id: str | None = None,
    store_region_id: str | None = None,
) -> Star:
    """The saved star, its facts from the files that can hold the slice, sliced."""
    given = {"product_id": product_id, "store_region_id": store_region_id}
    wanted = F.lit(True)
    for name, value in given.items():
        if value is not None:
            wanted = wanted & may_hold(name, value)

    def reader(name: str):
        if name in _FACTS:
            return lambda: read_files(spark, f"{folder}/{name}", wanted)
        return lambda: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")

    return Star(**{name: reader(name) for name in TABLES}).sliced(**given)


# ---- column against column -----------------------------------------------------


def _excess() -> Column:
    """How many times its forecast the stock is; infinite where no forecast can be exceeded.

    A double: rounding keeps the order, so a stock above ``factor`` times its forecast
    has at least the ratio ``factor``.
    """
    stock, forecast = F.col("inventory_level").cast("double"), F.col("demand_forecast").cast("double")
    return F.when(forecast > 0, stock / forecast).when(
        stock.isNotNull() & forecast.isNotNull(), F.lit(float("inf"))
    )


def save_by_excess(star: Star, path: str, file_rows: int = FILE_ROWS) -> None:
    """Save the inventory by the ratio of stock to forecast, its bounds in the listing."""
    inventory = star.inventory
    files = max(1, -(-inventory.count() // file_rows))
    # Ratios tie; the key behind them keeps a frequent one from filling one file.
    dealt = inventory.repartitionByRange(files, _excess(), *STORE_PRODUCT, "record_date")
    dealt.sortWithinPartitions(*STORE_PRODUCT, "record_date").write.parquet(f"{path}/rows")
    list_files(inventory.sparkSession, path, {"excess": _excess()})


def inventory_above(spark: SparkSession, path: str, factor: int) -> DataFrame:
    """Inventory from the files that can hold stock above ``factor`` times its forecast.

    Complete for reports that keep only such records, with ``factor`` >= 0.
    """
    if factor < 0:
        raise ValueError("ratios do not order records by a negative factor")
    return read_files(spark, path, F.col("greatest_excess") >= float(factor))


# ---- pages ---------------------------------------------------------------------

_AT = "__at"


def write_pages(report: Report, star: Star, path: str, **options) -> None:
    """Write a report in its presented order: sorted files, and where each begins.

    The order is that of a range sort; nothing is sorted again by a reader.
    """
    spark = star.inventory.sparkSession
    ordered = report.ordered(star, **options)
    # Ids rise by one inside a partition, and from each partition to the next.
    ordered.withColumn(_AT, F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    list_files(spark, f"{path}", {"at": F.col(_AT)})


def _places(spark: SparkSession, path: str) -> DataFrame:
    """The listing with the positions of each file's first and last row, from 1.

    A window over one line for each file.
    """
    before = F.sum("rows").over(Window.orderBy("least_at")) - F.col("rows")
    return listing(spark, path).select(
        _FILE, "least_at", (before + 1).alias("from"), (before + F.col("rows")).alias("to")
    )


def read_page(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of the presented order, with their ``position`` (from 1).

    Only the files that hold them are read, in them only the row groups with their ids;
    sort by ``position`` to show them. Positions beyond the last row give no rows.
    """
    shown = _places(spark, path).where((F.col("from") <= last) & (F.col("to") >= first)).collect()
    schema = spark.read.parquet(f"{path}/rows").schema
    columns = [name for name in schema.names if name != _AT]
    if not shown:
        empty = spark.createDataFrame([], schema).drop(_AT)
        return empty.withColumn("position", F.lit(None).cast("long"))
    # Of the files of a page, those in the middle belong to it whole.
    starts = sorted((row["least_at"], row["from"], row["to"], row[_FILE]) for row in shown)
    low = starts[0][0] + max(0, first - starts[0][1])
    high = starts[-1][0] + min(last, starts[-1][2]) - starts[-1][1]
    rows = spark.read.schema(schema).parquet(*[f"{path}/rows/{name}" for *_, name in starts])
    shifts = spark.createDataFrame(
        [(name, start - at) for at, start, _, name in starts], f"{_FILE} string, shift long"
    )
    placed = rows.where(F.col(_AT).between(low, high)).select(
        "*", F.col("_metadata.file_name").alias(_FILE)
    )
    return placed.join(shifts, _FILE).select(*columns, (F.col(_AT) + F.col("shift")).alias("position"))
