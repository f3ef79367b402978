"""All that the grouped reports ask of the facts, gathered in two passes over them.

The first pass adds up both facts per store-product and month (``operators.sums``).
Thresholds and both reorder points a store-product can have follow from these sums,
without a record. The second pass reads the stock records beside them and counts,
per store-product, the days below each threshold and at or below each reorder
point, and finds the medians. Reports on the star returned read what was kept;
those that list records read the stock records once each, for their rows.
Reports read the star's dimensions as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.operators.profile import LIMITS, flag_below, net_stock, understocked, with_threshold
from shelflight.operators.sums import CELLS, fact_cells, merge_cells
from shelflight.plans.demand import region_limits, regionally_understocked
from shelflight.plans.replenishment import LOW, low_counts, reorder_candidates
from shelflight.plans.stock_health import MEDIANS, median
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import Star
from shelflight.storage import fresh_path

# The thresholds of the reports; with other ones a report counts its days itself.
SIGMAS = (1.0, 1.3)
REGION_SIGMA = 1.0

_PARTS = (CELLS, "moments", "limits", "flags")


def gather(star: Star, folder: str | None = None) -> Star:
    """A star that knows what the grouped reports ask for, written below ``folder``.

    By default that is a new place in the shared folder. The tables are one row per
    store-product, and one per store-product and month.
    """
    spark = star.inventory.sparkSession
    folder = folder or fresh_path(spark, "gathered")

    def kept(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    cells = kept(CELLS, fact_cells(star))
    moments = kept("moments", merge_cells(cells, STORE_PRODUCT, "total_days"))
    limits = kept("limits", _limits(star, moments))
    kept("flags", _flags(star, limits))
    return gathered(spark, star, folder)


def gathered(spark: SparkSession, star: Star, folder: str) -> Star:
    """The star with what ``gather`` has written below ``folder``, in a later session too.

    The facts must be those it was gathered from.
    """
    ready = star.sliced()
    cells, moments, _, flags = [spark.read.parquet(f"{folder}/{name}") for name in _PARTS]
    known = {
        CELLS: cells,
        "moments": moments,
        MEDIANS: flags.select(*STORE_PRODUCT, "median_sales"),
        LOW: flags.select(*STORE_PRODUCT, "low_if_fast", "low_if_slow"),
        regionally_understocked(REGION_SIGMA): _short(flags, "short_region"),
    }
    known |= {understocked(s): _short(flags, f"short_{i}") for i, s in enumerate(SIGMAS)}
    for name, table in known.items():
        ready.derived(name, lambda table=table: table)
    return ready


def _short(flags: DataFrame, name: str) -> DataFrame:
    days = F.col(name)
    return flags.where(days > 0).select(*STORE_PRODUCT, days.alias("understock_days"))


def _limits(star: Star, moments: DataFrame) -> DataFrame:
    """Per store-product: its own limits, those of its region, both reorder points.

    A store-product whose store is unknown has no region, and is flagged for none.
    """
    own = reorder_candidates(with_threshold(moments, REGION_SIGMA))
    placed = moments.join(star.stores, "store_region_id")
    of_region = region_limits(placed, REGION_SIGMA).select(
        *STORE_PRODUCT, *[F.col(name).alias(f"region_{name}") for name in LIMITS]
    )
    return own.select(*STORE_PRODUCT, *LIMITS, "point_if_fast", "point_if_slow").join(
        of_region, STORE_PRODUCT, "left"
    )


def _flags(star: Star, limits: DataFrame) -> DataFrame:
    """Counts per store-product of what the stock records are flagged for, and medians."""
    records = star.inventory.select(
        *STORE_PRODUCT, "inventory_level", "units_sold", net_stock().alias("net")
    ).join(limits, STORE_PRODUCT)
    flags = []
    for at, sigma in enumerate(SIGMAS):
        records = flag_below(records, sigma).withColumnRenamed("below", f"below_{at}")
        flags.append(F.count_if(f"below_{at}").alias(f"short_{at}"))
    for name in LIMITS:
        records = records.drop(name).withColumnRenamed(f"region_{name}", name)
    records = flag_below(records, REGION_SIGMA)
    return records.groupBy(*STORE_PRODUCT).agg(
        *flags,
        F.count_if("below").alias("short_region"),
        *low_counts(),
        median(F.col("units_sold")).alias("median_sales"),
    )
