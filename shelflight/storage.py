"""Where tables are kept: the star on disk, and small tables cut from a plan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.schemas import STORE_PRODUCT, TABLES
from shelflight.star import Star

_SORT = {
    "inventory": [*STORE_PRODUCT, "record_date"],
    "pricing": [*STORE_PRODUCT, "record_date"],
    "store_events": ["store_region_id", "record_date"],
}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    spark.checkpoint.dir if set, else the context's checkpoint folder, else a
    folder in the warehouse. A cluster whose warehouse is a local path must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{warehouse}/settled"


_SETTLED: ContextVar[list[str] | None] = ContextVar("settled", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; inside ``settled_tables`` it is noted for removal."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if (noted := _SETTLED.get()) is not None:
        noted.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def settled_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables settled inside the block when it ends.

    Plans that read them must have run by then: write or collect results inside.
    """
    noted: list[str] = []
    token = _SETTLED.set(noted)
    try:
        yield
    finally:
        _SETTLED.reset(token)
        for path in noted:
            remove(spark, path)


def settle(table: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    ``by``: a column of few values that readers filter on; each reads its part only.

    The copy survives the loss of executors and has a known size on disk. A join
    to it is planned from that size: broadcast up to
    spark.sql.autoBroadcastJoinThreshold, beyond it a shuffled join that adaptive
    execution splits where a key is hot. Unsettled, an aggregate's size is unknown
    until it runs, and the other side is shuffled before the choice can be made.
    """
    spark = table.sparkSession
    path = fresh_path(spark, label)
    writer = table.write.partitionBy(by) if by else table.write
    writer.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def laid_out(table: DataFrame, name: str) -> DataFrame:
    """Rows of a store-product together and by date, in files of even size.

    The rebalance hint lets adaptive execution split a store-product that is too
    large for one file and merge small ones. Sorting narrows the row-group
    min/max ranges that filters on store, product or date skip by.
    """
    order = _SORT.get(name)
    if order is None:
        return table
    keys = order[:-1]
    return table.hint("rebalance", *keys).sortWithinPartitions(*order)


# Written last: a folder without it holds no whole star.
_WHOLE = "whole"


def write_star(star: Star, folder: str, mode: str = "errorifexists") -> None:
    """Write the six tables as parquet below ``folder``, then the mark that all are there."""
    spark = star.inventory.sparkSession
    if mode == "overwrite":
        remove(spark, f"{folder}/{_WHOLE}")
    for name in TABLES:
        laid_out(star.table(name), name).write.mode(mode).parquet(f"{folder}/{name}")
    names = spark.createDataFrame([(name,) for name in TABLES], "table_name string")
    names.coalesce(1).write.mode(mode).parquet(f"{folder}/{_WHOLE}")


def read_star(spark: SparkSession, folder: str) -> Star:
    """The six tables below ``folder``, under their declared schemas.

    A folder in which a write has not come to its end is refused.
    """
    spark.read.schema("table_name string").parquet(f"{folder}/{_WHOLE}")
    return Star(
        **{
            name: spark.read.schema(schema).parquet(f"{folder}/{name}")
            for name, schema in TABLES.items()
        }
    )


def save_bucketed(star: Star, prefix: str, buckets: int, mode: str = "errorifexists") -> None:
    """Save the star as catalog tables, the two large facts bucketed by store-product.

    Per-store-product aggregates, counts and windows then need no shuffle at all;
    with spark.sql.requireAllClusterKeysForCoPartition=false the join of the two
    facts needs none either. A bucket is read by one task: use this layout where
    the primary key holds, which bounds a store-product by its number of days.
    """
    for name in TABLES:
        table = star.table(name)
        if name in ("inventory", "pricing"):
            placed = table.repartition(buckets, *STORE_PRODUCT)
            writer = placed.write.bucketBy(buckets, *STORE_PRODUCT).sortBy(
                *STORE_PRODUCT, "record_date"
            )
        else:
            writer = table.write
        writer.mode(mode).saveAsTable(f"{prefix}{name}")


def bucketed_star(spark: SparkSession, prefix: str) -> Star:
    return Star(**{name: spark.table(f"{prefix}{name}") for name in TABLES})


def write_report(
    report: DataFrame, path: str, by_store_region: bool = True, mode: str = "errorifexists"
) -> None:
    """Write a report for a reader that slices by store-region.

    Rows are rebalanced on the slice column, so each store-region has few files
    and a very large one is still written by several tasks.
    """
    if by_store_region and "store_region_id" in report.columns:
        even = report.hint("rebalance", "store_region_id")
        even.write.mode(mode).partitionBy("store_region_id").parquet(path)
    else:
        report.write.mode(mode).parquet(path)


def slice_rows(
    report: DataFrame, product_id: str | None = None, store_region_id: str | None = None
) -> DataFrame:
    """The rows of one product and/or one store-region, where the report has them."""
    for name, wanted in (("product_id", product_id), ("store_region_id", store_region_id)):
        if wanted is not None:
            report = report.where(F.col(name) == wanted)
    return report
