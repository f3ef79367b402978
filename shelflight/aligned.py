"""Both facts cut at the same bounds, so that they join range by range.

The records of both facts are dealt together into ranges of (store-region, product,
day): a key has one range in both, and a store-product of very many days spans several.
Each range has a file in either table. The tables are bucketed by a number of the range
that is chosen to fall into a bucket of its own, so the engine knows that the files of a
range belong together: the facts join without an exchange, and no task holds more than
a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.schemas import STORE_PRODUCT, TABLES
from shelflight.star import RANGE, Star
from shelflight.storage import settle

_KEY = [*STORE_PRODUCT, "record_date"]
_FACTS = ("inventory", "pricing")
# Records of both facts in a range, about.
RANGE_ROWS = 2_000_000


def _numbers(spark: SparkSession, ranges: int) -> DataFrame:
    """(at, number): for each bucket a number that the engine's hash puts there."""
    tried = 4 * ranges + 64
    while True:
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(ranges)).alias("at")
        found = spark.range(tried).groupBy(bucket).agg(F.min("id").cast("int").alias(RANGE))
        found = settle(found, "range-numbers")
        if found.count() == ranges:
            return found
        tried *= 2


def _ranged(star: Star, ranges: int) -> DataFrame:
    """The records of both facts as (keys, the fact's columns as a struct, range)."""
    parts = [
        star.table(name).select(
            *_KEY,
            *[
                (F.struct(*star.table(other).columns) if other == name else F.lit(None)).alias(other)
                for other in _FACTS
            ],
        )
        for name in _FACTS
    ]
    dealt = parts[0].unionByName(parts[1]).repartitionByRange(ranges, *_KEY)
    placed = settle(dealt.withColumn("at", F.spark_partition_id()), "aligned-records")
    return placed.join(_numbers(star.inventory.sparkSession, ranges), "at")


def save_aligned(star: Star, prefix: str, folder: str, range_rows: int = RANGE_ROWS) -> int:
    """Save the star as tables ``prefix``... below ``folder``; returns the number of ranges.

    ``folder``/bounds lists each range's rows and its first and last key.
    """
    rows = sum(star.table(name).count() for name in _FACTS)
    ranges = max(1, -(-rows // range_rows))
    placed = _ranged(star, ranges)
    for name in TABLES:
        path = f"{folder}/{name}"
        if name in _FACTS:
            own = placed.where(F.col(name).isNotNull()).select(f"{name}.*", RANGE)
            # The engine deals by the hash that buckets go by: a file for each range.
            writer = own.repartition(ranges, RANGE).write.bucketBy(ranges, RANGE)
            writer = writer.sortBy(RANGE, "record_date", *STORE_PRODUCT)
        else:
            writer = star.table(name).write
        writer.option("path", path).saveAsTable(f"{prefix}{name}")
    key = F.struct(*_KEY)
    bounds = placed.groupBy(RANGE).agg(
        F.min(key).alias("first"),
        F.max(key).alias("last"),
        *[F.count(name).alias(f"{name}_rows") for name in _FACTS],
    )
    bounds.write.parquet(f"{folder}/bounds")
    return ranges


def aligned_star(spark: SparkSession, prefix: str) -> Star:
    """The saved star; plans that join both facts do so range by range.

    spark.sql.requireAllClusterKeysForCoPartition must be false, as ``prepare`` sets it.
    """
    return Star(**{name: spark.table(f"{prefix}{name}") for name in TABLES})


def attach(spark: SparkSession, prefix: str, folder: str) -> Star:
    """Name the tables saved below ``folder`` in a session whose catalog lacks them."""
    ranges = spark.read.parquet(f"{folder}/bounds").count()
    for name, schema in TABLES.items():
        columns = [f"{f.name} {f.dataType.simpleString()}" for f in schema]
        layout = ""
        if name in _FACTS:
            columns.append(f"{RANGE} int")
            order = ", ".join([RANGE, "record_date", *STORE_PRODUCT])
            layout = f"CLUSTERED BY ({RANGE}) SORTED BY ({order}) INTO {ranges} BUCKETS"
        spark.sql(
            f"CREATE TABLE {prefix}{name} ({', '.join(columns)}) USING parquet {layout} "
            f"LOCATION '{folder}/{name}'"
        )
    return aligned_star(spark, prefix)
