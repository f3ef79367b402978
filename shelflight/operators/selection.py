"""The two middle values of very large groups, without a group in one task.

A round counts the records of each group in ranges between the group's least and
greatest value that can still be the middle one. Only the range with the middle goes
into the next round. A task hands over at most ``RANGES`` rows of a group, whatever the
number of its records or different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.storage import settle

# Ranges that a group is cut into by a round. Groups whose values span no more end after one round;
# a span of 32 bits takes four rounds at most.
RANGES = 1024

_LEAST, _GREATEST, _RANK, _ROWS = "__least", "__greatest", "__rank", "__rows"
_LOWER, _UPPER = "__lower", "__upper"


def _one_round(
    records: DataFrame, targets: DataFrame, keys: list[str], ranges: int
) -> DataFrame:
    """The targets with the range that holds their lower middle value.

    Found where both middle values are known: they lie in two ranges, as the greatest of
    one and the least of the next, or the range has one value. Else the next round looks
    between the range's least and greatest value.
    """
    value = F.col("__value")
    # Not multiplied, so that no product of wide numbers arises; a span of over 63 bits fails.
    step = F.expr(f"({_GREATEST} - {_LEAST}) div {ranges} + 1")
    at = F.expr(f"(__value - {_LEAST}) div __step").alias("__range")
    limits = targets.select(*keys, _LEAST, _GREATEST, step.alias("__step"))
    counted = (
        records.join(limits, keys)
        .where(value.between(F.col(_LEAST), F.col(_GREATEST)))
        .groupBy(*keys, at)
        .agg(
            F.count("*").alias("__n"), F.min(value).alias("__first"), F.max(value).alias("__last")
        )
    )
    # At most ``ranges`` rows of a group.
    ordered = Window.partitionBy(*keys).orderBy("__range")
    placed = counted.select(
        *keys, "__n", "__first", "__last",
        (F.sum("__n").over(ordered) - F.col("__n")).alias("__before"),
        F.lead("__first").over(ordered).alias("__next"),
    )
    rank = F.col(_RANK) - F.col("__before")
    last = rank == F.col("__n") - 1  # of its range; the upper middle value is in the next one
    alone = F.col("__first") == F.col("__last")
    upper = F.when(F.col(_ROWS) % 2 == 1, F.col("__last")).otherwise(F.col("__next"))
    return (
        targets.select(*keys, _RANK, _ROWS)
        .join(placed, keys)
        .where((rank >= 0) & (rank < F.col("__n")))
        .select(
            *keys,
            F.col("__first").alias(_LEAST),
            F.col("__last").alias(_GREATEST),
            rank.alias(_RANK),
            # Further rounds only see this range: its records count, and whether two are sought.
            _ROWS,
            F.when(last, F.col("__last")).when(alone, F.col("__first")).alias(_LOWER),
            F.when(last, upper).when(alone, F.col("__first")).alias(_UPPER),
        )
    )


def middle_values(
    records: DataFrame, keys: list[str], value: Column, limits: DataFrame, ranges: int = RANGES
) -> DataFrame:
    """``keys`` with ``lower`` and ``upper``: the middle values of each group, exact.

    ``value`` is a whole number; NULLs sort first and take part in the ranks, so a
    middle value may be NULL. ``limits`` is settled and has, for each group, ``rows``,
    ``known`` (rows that are not NULL), ``least`` and ``greatest``. Keys are not NULL.

    Groups meet their limits in a join on the group, planned from the size of the limits;
    each round reads the records again, but the groups still open only, and the driver
    learns whether there are any.
    """
    if ranges < 2:
        raise ValueError("a round needs two ranges to tell values apart")
    nulls = F.col("rows") - F.col("known")
    low = F.expr("(rows - 1) div 2") - nulls
    high = F.expr("rows div 2") - nulls
    found = limits.where(low < 0).select(
        *keys,
        F.lit(None).cast("long").alias("lower"),
        F.when(high >= 0, F.col("least").cast("long")).alias("upper"),
    )
    targets = limits.where(low >= 0).select(
        *keys,
        F.col("least").cast("long").alias(_LEAST),
        F.col("greatest").cast("long").alias(_GREATEST),
        low.alias(_RANK),
        F.col("rows").alias(_ROWS),
    )
    valued = records.select(*keys, value.cast("long").alias("__value"))
    open_groups = targets
    while True:
        after = settle(_one_round(valued, open_groups, keys, ranges), "middle-ranges")
        done = F.col(_UPPER).isNotNull()
        found = found.unionByName(
            after.where(done).select(*keys, F.col(_LOWER).alias("lower"), F.col(_UPPER).alias("upper"))
        )
        open_groups = after.where(~done).drop(_LOWER, _UPPER)
        if open_groups.isEmpty():
            return found
