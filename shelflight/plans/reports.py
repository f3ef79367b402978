"""The reports by name, with the row order in which each is presented.

The plan functions return unordered rows, for use in further jobs. Every order
here ends on the grain of the report, so equal values neither leave the order
open nor gather in one task of the range sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflight.plans import demand, replenishment, rollups, stock_health
from shelflight.plans.gathering import gather, gathered
from shelflight.star import Star
from shelflight.storage import settle, settled_tables, write_report


@dataclass(frozen=True)
class Report:
    plan: Callable[..., DataFrame]
    order: tuple[str, ...]  # a leading "-" sorts descending
    hidden: tuple[str, ...] = ()  # sorted by, not shown
    reread: tuple[str, ...] = ()  # measures of the facts that the plan reads twice
    dims: tuple[str, ...] = ()  # dimensions that the plan joins
    per_record: bool = False  # lists stock records, so it is as large as the fact

    def rows(self, star: Star, **options) -> DataFrame:
        """The report without its order."""
        return self.plan(star, **options).drop(*self.hidden)

    def ordered(self, star: Star, **options) -> DataFrame:
        keys = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in self.order]
        return self.plan(star, **options).orderBy(*keys).drop(*self.hidden)

    def numbered(self, star: Star, **options) -> DataFrame:
        """The rows with their place in the presented order, from 1.

        Each sorted partition numbers its rows; the partitions' sizes, one row each,
        give every partition its first place. No task holds more than a partition.
        """
        ordered = self.ordered(star, **options)
        marks = {"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}
        placed = settle(ordered.withColumns(marks), "presented")
        sizes = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
        before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")
        starts = sizes.select("__part", (before - F.col("first") + 1).alias("shift"))
        # Ids rise by one inside a partition.
        return placed.join(starts, "__part").select(
            *ordered.columns, (F.col("__at") + F.col("shift")).alias("position")
        )


# Measures of the facts, as the reports that read them twice name them.
_STOCK = ("inventory_level", "units_sold")
_PRICED_STOCK = (*_STOCK, "price")

REPORTS: dict[str, Report] = {
    "sales_profile": Report(stock_health.sales_profile, ("store_region_id", "product_id")),
    "stock_level": Report(
        stock_health.stock_level,
        ("store_region_id", "product_id", "record_date"),
        reread=_STOCK,
        dims=("products",),
        per_record=True,
    ),
    "movement": Report(
        stock_health.movement,
        ("-understock_percentage", "store_region_id", "product_id"),
        reread=_STOCK,
    ),
    "overstock": Report(
        stock_health.overstock,
        ("-overstock_amount", "store_region_id", "product_id", "inventory_level"),
        per_record=True,
    ),
    "category_summary": Report(demand.category_summary, ("category",)),
    "forecast_accuracy": Report(
        demand.forecast_accuracy, ("-avg_forecast_error", "store_region_id", "product_id")
    ),
    "competitor_pricing": Report(
        demand.competitor_pricing,
        ("-avg_competitor_price", "product_id"),
        reread=("units_sold", "price", "competitor_pricing"),
        dims=("products",),
    ),
    "stockout_by_store": Report(
        stock_health.stockout_by_store,
        ("-stockout_rate_percentage", "store_region_id"),
        reread=_STOCK,
    ),
    "discount_effect": Report(
        demand.discount_effect,
        ("-avg_discount", "product_id"),
        reread=("units_sold", "discount"),
        dims=("products",),
    ),
    "reorder_point": Report(
        replenishment.reorder_points,
        ("store_region_id", "product_id"),
        reread=_STOCK,
        dims=("products",),
    ),
    "low_inventory": Report(
        replenishment.low_inventory,
        ("record_date", "store_region_id", "product_id"),
        reread=_STOCK,
        dims=("products",),
        per_record=True,
    ),
    "turnover": Report(
        demand.turnover,
        ("-inventory_turnover_ratio", "product_id"),
        reread=_PRICED_STOCK,
        dims=("products",),
    ),
    "regional_summary": Report(
        demand.regional_summary, ("region",), reread=_STOCK, dims=("stores",)
    ),
    "kpi_summary": Report(
        demand.kpi_summary,
        ("store_region_id", "product_id"),
        reread=_STOCK,
        dims=("products",),
    ),
    "seasonal_demand": Report(
        demand.seasonal_demand,
        ("store_region_id", "seasonality", "category", "month_num"),
        hidden=("month_num",),
    ),
    "safety_stock": Report(
        replenishment.safety_stock, ("store_region_id", "product_id"), reread=_STOCK
    ),
    "stock_recommendations": Report(
        replenishment.stock_recommendations,
        ("-priority_score", "-holding_cost", "store_region_id", "product_id"),
        reread=_PRICED_STOCK,
        dims=("products", "seasonality"),
    ),
    "low_inventory_rollup": Report(
        rollups.low_inventory_rollup,
        ("dimension", "member"),
        reread=_STOCK,
        dims=("products",),
    ),
    "reorder_vs_sales_rollup": Report(
        rollups.reorder_vs_sales_rollup,
        ("dimension", "member"),
        reread=_STOCK,
        dims=("products",),
    ),
    "monthly_trend": Report(rollups.monthly_trend, ("month_start",)),
    "turnover_by_category": Report(
        rollups.turnover_by_category,
        ("-inventory_turnover_ratio", "category"),
        reread=_PRICED_STOCK,
        dims=("products",),
    ),
}


# Below the folder of refreshed reports: what they were computed from.
_GATHERED = "gathered"


def refresh_reports(
    star: Star, folder: str, names: list[str] | None = None, records: bool = True
) -> None:
    """Write reports below ``folder`` as files that a reader can slice.

    All reports together read the price records once and the stock records twice,
    see ``plans.gathering``, and once more for each of the three that list records.
    Without ``records`` these are not written: ``record_report`` computes them, or a
    slice of them, from what was gathered. ``names`` writes some reports only, each
    from the facts. Rows are written unordered; a reader orders the few it shows.
    Tables settled on the way are removed at the end, so the star keeps none of them.
    """
    with settled_tables(star.inventory.sparkSession):
        # What it derives goes with the settled tables.
        fresh = star.sliced() if names else gather(star, f"{folder}/{_GATHERED}")
        for name in names or REPORTS:
            if records or not REPORTS[name].per_record:
                write_report(REPORTS[name].rows(fresh), f"{folder}/{name}", mode="overwrite")


def record_report(star: Star, folder: str, name: str, **slices: str) -> DataFrame:
    """A report that lists records, or one slice, by the thresholds of the last refresh.

    The star must be the one the reports below ``folder`` were refreshed from, whole.
    A slice of it reads the stock records of the slice only.
    """
    if not REPORTS[name].per_record:
        raise ValueError(f"{name} lists no records, read its files")
    spark = star.inventory.sparkSession
    return REPORTS[name].rows(gathered(spark, star.sliced(**slices), f"{folder}/{_GATHERED}"))
