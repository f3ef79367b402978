
from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import partial, reduce
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracles.sql import ORACLES
from shelflight import snapshots
from shelflight.aligned import aligned_star, save_aligned
from shelflight.listed import (
    inventory_above,
    read_page,
    read_slice,
    save_by_excess,
    save_sliceable,
    write_pages,
)
from shelflight.operators import estimates, normalize, quality
from shelflight.plans.gathering import gather
from shelflight.plans.load import append_records, load_warnings
from shelflight.plans.reports import REPORTS, Report
from shelflight.plans.stock_health import movement_from_counts, sales_profile_selected
from shelflight.schemas import TABLES
from shelflight.session import prepare
from shelflight.sources import csv_records, sample_tables
from shelflight.star import Star
from shelflight.storage import fresh_path, read_star, settle, write_star

# The operators on documents come and go with their folder.
if importlib.util.find_spec("shelflight.llm") and importlib.util.find_spec("corpus_pipeline"):
    from shelflight.llm import queries as documents
else:
    documents = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"

_TABLE_QUERIES = {
    "dim_stores": "stores",
    "dim_products": "products",
    "dim_seasonality": "seasonality",
    "fact_store_events": "store_events",
}


# Reports also run over a sample with NULLs, and whether sales are among them.
_WITH_GAPS = {"sales_profile": True, "seasonal_demand": False}
# One report for each kind of order: ascending, descending, mixed.
_RANKED = ("sales_profile", "movement", "stock_recommendations")
# One report for each kind of sum or count that a refresh gathers for all.
_GATHERED = (
    "sales_profile",
    "turnover",
    "discount_effect",
    "regional_summary",
    "seasonal_demand",
    "stock_recommendations",
    "low_inventory",
    "low_inventory_rollup",
)


def _comparable(rows: DataFrame) -> DataFrame:
    """Decimals as doubles: both engines then hand over the same value type."""
    return rows.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in rows.schema
        ]
    )


def _report(report: Report, spark: SparkSession, sf_dir: str) -> DataFrame:
    star = sample_tables.star(spark, sf_dir, report.reread, report.dims)
    return _comparable(report.ordered(star))


def _table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(sample_tables.star(spark, sf_dir).table(name))


def _pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the first-wins rule, although daily records no longer repeat a key."""
    daily = sample_tables.daily_records(sample_tables.staging(spark, sf_dir, weather=False))
    return _comparable(normalize.pricing(daily))


def _load_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the sample as a raw CSV file and load it under the declared schema."""
    path = fresh_path(spark, "raw-records")
    csv_records.write_records(sample_tables.staging(spark, sf_dir), path)
    return _comparable(csv_records.read_strict(spark, path))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = sample_tables.daily_records(sample_tables.staging(spark, sf_dir, weather=False))
    return _comparable(normalize.inventory(daily))


def _load_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load raw lines that no writer of ours made, every field of every row."""
    path = fresh_path(spark, "raw-lines")
    sample_tables.write_raw_lines(spark, sf_dir, path, wrong=False)
    return _comparable(csv_records.read_strict(spark, path))


def _load_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load raw text with line breaks inside quotes, every field of every row."""
    path = fresh_path(spark, "raw-lines")
    sample_tables.write_raw_lines(spark, sf_dir, path, breaks=True)
    return _comparable(csv_records.read_strict(spark, path, multiline=True))


def _load_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load raw lines of which some are wrong: what is accepted and set aside, by product."""
    path = fresh_path(spark, "raw-lines")
    sample_tables.write_raw_lines(spark, sf_dir, path, wrong=True)
    accepted, rejected = csv_records.read_tolerant(spark, path)
    product = F.split_part(F.col(csv_records.REJECTED), F.lit(","), F.lit(3))
    good = accepted.select("product_id", F.lit("accepted").alias("outcome"), "inventory_level")
    bad = rejected.select(
        product.alias("product_id"),
        F.lit("rejected").alias("outcome"),
        F.lit(None).cast("int").alias("inventory_level"),
    )
    return good.unionByName(bad).groupBy("product_id", "outcome").agg(
        F.count("*").alias("lines"),
        F.coalesce(F.sum("inventory_level"), F.lit(0)).alias("inventory_total"),
    )


def _load_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load raw lines of which some are wrong: why they are, and the keys that repeat."""
    path = fresh_path(spark, "raw-lines")
    sample_tables.write_raw_lines(spark, sf_dir, path, wrong=True)
    return load_warnings(*csv_records.read_explained(spark, path))


def _contents(table: DataFrame) -> list[Column]:
    """Sums over all columns of a kind: rows, text lengths, numbers, days, set flags."""
    kinds = {"string": [], "number": [], "date": [], "boolean": []}
    for f in table.schema:
        name = f.dataType.typeName()
        kinds[name if name in kinds else "number"].append(f.name)

    def total(columns: list[str], value: Callable[[str], Column], kind: str) -> Column:
        parts = [F.coalesce(F.sum(value(c)).cast(kind), F.lit(0).cast(kind)) for c in columns]
        return reduce(lambda a, b: a + b, parts, F.lit(0).cast(kind))

    days = F.to_date(F.lit("1970-01-01"))
    return [
        F.count("*").alias("rows"),
        total(kinds["string"], lambda c: F.length(c).cast("long"), "long").alias("text_length"),
        total(kinds["number"], lambda c: F.col(c).cast("decimal(20,2)"), "decimal(30,2)")
        .cast("double")
        .alias("number_total"),
        total(kinds["date"], lambda c: F.datediff(c, days).cast("long"), "long").alias("day_total"),
        total(kinds["boolean"], lambda c: F.col(c).cast("long"), "long").alias("flag_total"),
    ]


def _star_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the star as files and sum what a reader of the files finds."""
    folder = fresh_path(spark, "star")
    write_star(sample_tables.star(spark, sf_dir, settled=sample_tables.MEASURES), folder)
    return _summed(read_star(spark, folder))


def _summed(star: Star) -> DataFrame:
    sums = [
        star.table(name).agg(*_contents(star.table(name))).withColumn("table_name", F.lit(name))
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, sums)


def _appended(spark: SparkSession, sf_dir: str) -> tuple[Star, DataFrame]:
    """Load the sample up to a day, then append the rest with days that are stored already."""
    folder = fresh_path(spark, "snapshots")
    for rows in sample_tables.two_loads(spark, sf_dir):
        path = fresh_path(spark, "raw-records")
        csv_records.write_records(rows, path)
        star, conflicts = append_records(spark, path, folder, ignore_inventory=True)
    return star, conflicts


def _movement_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement after three loads, from what each load counted of its own records."""
    folder = fresh_path(spark, "snapshots")
    daily = settle(sample_tables.daily_staging(spark, sf_dir), "daily-staging")
    year = F.year("record_date")
    for load in (year < 1994, (year >= 1994) & (year < 1997), year >= 1997):
        snapshot, _ = snapshots.append(spark, daily.where(load), folder)
    return _comparable(movement_from_counts(snapshot.net_counts(spark)))


def _aligned(report: Report, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from facts that are stored at the same bounds and join range by range."""
    prefix = f"aligned_{uuid4().hex}_"
    star = sample_tables.star(spark, sf_dir, settled=sample_tables.MEASURES)
    save_aligned(star, prefix, fresh_path(spark, "aligned"), range_rows=100_000)
    return _comparable(report.ordered(aligned_star(spark, prefix)))


def _gathered(report: Report, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a refresh computes it, from what two passes over the facts gathered."""
    dims = ("products", "seasonality", "stores")
    star = sample_tables.star(spark, sf_dir, settled=sample_tables.MEASURES, dims=dims)
    return _comparable(report.ordered(gather(star)))


def _load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the star holds after both loads: the sums of a single load."""
    return _summed(_appended(spark, sf_dir)[0])


def _load_append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir)[1]


def _duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging rows are settled: six tables are checked from one join of the base."""
    return quality.duplicate_keys(settle(sample_tables.staging(spark, sf_dir), "staging"))


def _gaps(report: Report, sales: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    star = sample_tables.with_gaps(sample_tables.star(spark, sf_dir), sales)
    return _comparable(report.ordered(star))


def _selected(sales: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians narrowed down range by range, with and without NULLs."""
    star = sample_tables.star(spark, sf_dir, settled=("units_sold",))
    return sales_profile_selected(sample_tables.with_gaps(star, sales) if sales else star)


def _numbered(report: Report, spark: SparkSession, sf_dir: str) -> DataFrame:
    star = sample_tables.star(spark, sf_dir, report.reread, report.dims)
    return _comparable(report.numbered(star))


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slicer: one store-region, sliced before anything is summed."""
    report = REPORTS["movement"]
    star = sample_tables.star(spark, sf_dir, report.reread, report.dims)
    return _comparable(report.ordered(star.sliced(store_region_id="NATION_21_AMERICA")))


def _loads(star: Star) -> list[DataFrame]:
    """The sample's inventory as three loads."""
    year = F.year("record_date")
    parts = (year < 1994, (year >= 1994) & (year < 1997), year >= 1997)
    return [star.inventory.where(part) for part in parts]


def _medians_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians from sketches that three loads stored, held against the records."""
    star = sample_tables.star(spark, sf_dir, settled=("units_sold",))
    stored = [settle(estimates.median_sketches(load), "sketches") for load in _loads(star)]
    united = estimates.united_medians(reduce(DataFrame.unionByName, stored))
    found = settle(estimates.estimated_medians(united), "estimates")
    return estimates.medians_checked(found, star.inventory)


def _products_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products per region from sketches that three loads stored, beside the exact number."""
    star = sample_tables.star(spark, sf_dir, settled=("units_sold",), dims=("stores",))
    stores = settle(star.stores, "stores")
    stored = [settle(estimates.product_sketches(load, stores), "sketches") for load in _loads(star)]
    united = estimates.united_products(reduce(DataFrame.unionByName, stored))
    return estimates.products_checked(estimates.estimated_products(united), star.inventory, stores)


def _listed_slice(given: dict[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product or one store-region of a star in Z-order, from the files that hold it."""
    report = REPORTS["movement"]
    folder = fresh_path(spark, "sliceable")
    star = sample_tables.star(spark, sf_dir, settled=sample_tables.MEASURES)
    save_sliceable(star, folder, file_rows=10_000)
    return _comparable(report.ordered(read_slice(spark, folder, **given)))


def _overstock_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overstock from the files whose stock can exceed twice the forecast."""
    path = fresh_path(spark, "by-excess")
    star = sample_tables.star(spark, sf_dir, settled=sample_tables.MEASURES)
    save_by_excess(star, path, file_rows=10_000)
    files = Star(inventory=lambda: inventory_above(spark, path, 2))
    return _comparable(REPORTS["overstock"].ordered(files))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 1,001 to 2,500 of the stock levels in their presented order."""
    path = fresh_path(spark, "pages")
    report = REPORTS["stock_level"]
    write_pages(report, sample_tables.star(spark, sf_dir, report.reread, report.dims), path)
    return _comparable(read_page(spark, path, 1_001, 2_500))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(sample_tables.star(spark, sf_dir, settled=sample_tables.MEASURES))


def _domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.domain(sample_tables.staging(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Stock recommendations over the smallest sample."""
    return queries()["stock_recommendations"](spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = {
        "load_staging": _load_staging,
        **{query: partial(_table, table) for query, table in _TABLE_QUERIES.items()},
        "load_quoted": _load_quoted,
        "load_multiline": _load_multiline,
        "load_tolerant": _load_tolerant,
        "load_warnings": _load_warnings,
        "fact_inventory": _inventory,
        "fact_pricing": _pricing,
        "star_tables": _star_tables,
        "load_append": _load_append,
        "load_append_conflicts": _load_append_conflicts,
        "dq_duplicate_keys": _duplicate_keys,
        "dq_orphans": _orphans,
        "dq_domain": _domain,
        **{name: partial(_report, report) for name, report in REPORTS.items()},
        **{f"{name}_gaps": partial(_gaps, REPORTS[name], sales) for name, sales in _WITH_GAPS.items()},
        "sales_profile_selected": partial(_selected, False),
        "sales_profile_selected_gaps": partial(_selected, True),
        **{f"{name}_ranked": partial(_numbered, REPORTS[name]) for name in _RANKED},
        "movement_slice": _slice,
        "sales_median_estimated": _medians_estimated,
        "regional_products_estimated": _products_estimated,
        "slice_by_product": partial(_listed_slice, {"product_id": "Brand#23"}),
        "slice_by_store": partial(_listed_slice, {"store_region_id": "NATION_21_AMERICA"}),
        "overstock_pruned": _overstock_pruned,
        "stock_level_page": _page,
        "movement_incremental": _movement_incremental,
        **{f"{name}_gathered": partial(_gathered, REPORTS[name]) for name in _GATHERED},
        "competitor_pricing_aligned": partial(_aligned, REPORTS["competitor_pricing"]),
        "discount_effect_aligned": partial(_aligned, REPORTS["discount_effect"]),
    }
    registered = {name: partial(_run, plan) for name, plan in plans.items()}
    if documents:
        registered |= documents.QUERIES
    return registered


def _run(plan: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    # Python workers started from here on find the package where the driver does.
    root = str(Path(__file__).resolve().parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return plan(prepare(spark), sf_dir)


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **(documents.ORACLES if documents else {})}
