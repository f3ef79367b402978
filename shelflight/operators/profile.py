"""Stock thresholds, understock flags and their rates per group.

``net`` is the stock left after the day's sales. A group's threshold is
mean(net) - sigma * population deviation(net); a record is understocked when its
net lies strictly below it.

Groups are described by sums, which combine map-side however many records a
group holds, and which merge into the sums of coarser groups. The records then
meet their group's threshold in a join to a table of known size: no record is
shuffled while that table can be broadcast, and no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions.numeric import ratio, scaled_spread, whole
from shelflight.schemas import STORE_PRODUCT
from shelflight.star import Star
from shelflight.storage import settle

# What the flag of a record needs to know of its group.
LIMITS = ["net_rows", "net_sum", "net_spread"]

SUMS = [
    "total_days",
    "net_rows",
    "net_sum",
    "net_squares",
    "stock_rows",
    "stock_sum",
    "sold_rows",
    "sold_sum",
    "sold_squares",
]


def net_stock() -> Column:
    return F.col("inventory_level").cast("bigint") - F.col("units_sold")


def sum_of_squares(value: Column) -> Column:
    """Exact sum of squares of an integer column.

    The squares are summed in two parts, each a plain 64-bit sum, which are put
    together once per group: a decimal sum per record doubles the aggregate's time.
    """
    square = value.cast("bigint") * value
    high = F.sum(F.shiftright(square, 20))
    low = F.sum(square.bitwiseAND(F.lit((1 << 20) - 1)))
    return whole(high) * (1 << 20) + low


# ---- groups --------------------------------------------------------------------


def group_moments(inventory: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Counts and sums per group; those a report does not read are pruned."""
    net, sold = F.col("net"), F.col("units_sold")
    return (
        inventory.withColumn("net", net_stock())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_days"),
            F.count(net).alias("net_rows"),
            F.sum(net).alias("net_sum"),
            sum_of_squares(net).alias("net_squares"),
            F.count("inventory_level").alias("stock_rows"),
            F.sum("inventory_level").alias("stock_sum"),
            F.count(sold).alias("sold_rows"),
            F.sum(sold).alias("sold_sum"),
            sum_of_squares(sold).alias("sold_squares"),
            *sums,
        )
    )


def merge_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums of coarser groups from those of finer ones."""
    return moments.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in SUMS])


def with_threshold(moments: DataFrame, sigma: float) -> DataFrame:
    """Moments with the threshold of each group and the spread behind it."""
    rows, total = F.col("net_rows"), F.col("net_sum")
    spread = scaled_spread(rows, total, F.col("net_squares"))
    return moments.withColumn("net_spread", spread).withColumn(
        "threshold", ratio(total, rows) - sigma * ratio(F.col("net_spread"), rows)
    )


# ---- records -------------------------------------------------------------------


def flag_below(records: DataFrame, sigma: float) -> DataFrame:
    """Mark the records whose ``net`` lies below the threshold of their group.

    The records carry the ``LIMITS`` of their group. The test is
    total - rows * net > sigma * (rows * deviation), the threshold multiplied out.
    Its left side is a whole number, so rounding noise cannot flag a net that lies
    exactly on the threshold. NULL is not flagged.
    """
    gap = (F.col("net_sum") - F.col("net_rows") * F.col("net")).cast("double")
    return records.withColumn("below", F.coalesce(gap > F.col("net_spread") * sigma, F.lit(False)))


def flag_rate(inventory: DataFrame, limits: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """``limits`` with the flagged days of each group and their percentage.

    ``limits`` has one row per group, with its ``LIMITS`` and ``total_days``. Only
    flagged records are counted, map-side first.
    """
    records = inventory.select(*keys, net_stock().alias("net"))
    flagged = flag_below(records.join(limits.select(*keys, *LIMITS), keys), sigma)
    short = flagged.where("below").groupBy(*keys).agg(F.count("*").alias("understock_days"))
    return rated(limits, short, keys)


def rated(limits: DataFrame, short: DataFrame, keys: list[str]) -> DataFrame:
    """``limits`` with their flagged days, where there are any, and the percentage."""
    days = F.coalesce("understock_days", F.lit(0))
    return limits.join(short, keys, "left").withColumns(
        {
            "understock_days": days,
            "understock_percentage": ratio(days * 100, F.col("total_days")),
        }
    )


def settled_moments(inventory: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """``group_moments`` written to the shared folder, so that joins know its size."""
    return settle(group_moments(inventory, keys, *sums), "moments")


def understock_profile(
    inventory: DataFrame, moments: DataFrame, keys: list[str], sigma: float
) -> DataFrame:
    """One row per group of settled moments: threshold, flagged days, means, deviations."""
    return described(flag_rate(inventory, with_threshold(moments, sigma), keys, sigma))


def described(profile: DataFrame) -> DataFrame:
    """Means and deviations of groups whose sums and flagged days are known."""
    sold_rows = F.col("sold_rows")
    sold_spread = scaled_spread(sold_rows, F.col("sold_sum"), F.col("sold_squares"))
    return profile.withColumns(
        {
            "spread_net": ratio(F.col("net_spread"), F.col("net_rows")),
            "mean_inventory": ratio(F.col("stock_sum"), F.col("stock_rows")),
            "mean_sales": ratio(F.col("sold_sum"), sold_rows),
            "spread_sales": ratio(sold_spread, sold_rows),
        }
    )


# ---- counts kept up to date ------------------------------------------------------


def net_counts(inventory: DataFrame) -> DataFrame:
    """Records per store-product and net; those of several loads are merged by adding up."""
    nets = inventory.select(*STORE_PRODUCT, net_stock().alias("net"))
    return merge_counts(nets.withColumn("days", F.lit(1).cast("long")))


def merge_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*STORE_PRODUCT, "net").agg(F.sum("days").alias("days"))


def counted_profile(counts: DataFrame, sigma: float) -> DataFrame:
    """Threshold and flagged days per store-product, from counts instead of records.

    ``counts`` may hold a net several times, as loads have left it. The rows of a
    store-product are as many as its different nets, and are added up map-side.
    """
    net, days = F.col("net"), F.col("days")
    known = F.when(net.isNotNull(), days)
    square = net.cast("decimal(20,0)") * net
    moments = counts.groupBy(*STORE_PRODUCT).agg(
        F.sum(days).alias("total_days"),
        F.coalesce(F.sum(known), F.lit(0)).alias("net_rows"),
        F.sum(net * days).alias("net_sum"),
        F.sum((square * days).cast("decimal(38,0)")).alias("net_squares"),
    )
    limits = settle(with_threshold(moments, sigma), "thresholds")
    flagged = flag_below(counts.join(limits.select(*STORE_PRODUCT, *LIMITS), STORE_PRODUCT), sigma)
    short = flagged.where("below").groupBy(*STORE_PRODUCT).agg(F.sum("days").alias("understock_days"))
    return rated(limits, short, STORE_PRODUCT)


# ---- store-products of a star ----------------------------------------------------


def store_product_moments(star: Star) -> DataFrame:
    """Settled moments per store-product, shared by the reports on one star."""
    return star.derived("moments", lambda: settled_moments(star.inventory, STORE_PRODUCT))


def understocked(sigma: float) -> str:
    """Name under which a star knows the flagged days of its store-products."""
    return f"understock {sigma}"


def store_product_profile(
    star: Star, sigma: float, moments: DataFrame | None = None
) -> DataFrame:
    """Profile of the store-products; days that the star has counted are not counted again."""
    moments = store_product_moments(star) if moments is None else moments
    short = star.known(understocked(sigma))
    if short is None:
        return understock_profile(star.inventory, moments, STORE_PRODUCT, sigma)
    return described(rated(with_threshold(moments, sigma), short, STORE_PRODUCT))
