"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

Every source has a weight and thereby a share of the words wanted; no target
exceeds ``most`` times its source. The excess is shared by weight among the
others until none is above.

A document's place in its source is a hash of its doc_id. Rows that share source,
doc_id and text stand at one spot, which is summed first: a hot doc_id is a row. The
hash space is cut into equal ranges, narrow enough that one range of the largest source
is a small task, so the spots of a hot source spread over many. Sums per range give
each range its prefix, in two levels, so that no task adds up all ranges of a source; a
running sum inside the range gives each spot's. The spot at which a source's budget ends
is its cut. Whole documents are taken: the one on the cut if at least half of it fits,
and of the rows at its spot as many as fit. Targets above a source's size repeat the
order: whole epochs, then the same cut.

Nulls: a null text has size 0; a null source is a source of its own and sorts
last. Where some rows of a spot are taken once more than others, the first ones in the
table are; they differ at most in other columns. Sources without words get target 0. An
empty table gives an empty result. Other columns are passed through by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import BLANK_CLASS, settle, text_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 7
# Rows of one source that one task sorts, about.
RANGE_ROWS = 4_000


def size_in_words(text: Column | str = "text") -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK_CLASS}]+")).cast("long")


def place(seed: int) -> Column:
    """Where a document stands in its source: 32 hexadecimal digits, compared as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Add the target to (source, source_size, ...), one row per source.

    The level is what a weight of 1 gets. Sources whose share exceeds their limit are
    held at it, and the level rises for the others until none is above. The sources
    are ranked in one task; they are few beside the documents.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    weighed = settle(
        sources.withColumn("weight", weight.cast("double")).withColumn(
            "limit", F.col("source_size") * F.lit(float(most))
        ),
        "mixing-sources",
    )
    wanted = share * float(weighed.agg(F.sum("source_size").alias("words")).first().words or 0)
    level = 0.0
    while True:
        held = F.col("limit") <= F.col("weight") * level
        now = weighed.agg(
            F.sum(F.when(held, F.col("limit"))).alias("held"),
            F.sum(F.when(~held, F.col("weight"))).alias("free"),
        ).first()
        risen = (wanted - (now.held or 0.0)) / now.free if now.free else level
        if risen <= level:
            break
        level = risen
    target = F.round(F.least(F.col("limit"), F.col("weight") * level), 6)
    return weighed.withColumn("target", target).drop("limit", "weight")


def _named(rows: DataFrame) -> DataFrame:
    """The source as a key that is never null, and whether it was."""
    return rows.withColumns(
        {"key": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()}
    )


_SOURCE = ["key", "unnamed"]
_SPOT = ["place", "doc_id", "text_key"]


def _starts(per_range: DataFrame, digits: int) -> DataFrame:
    """Add the sum of all lower ranges of the source, by way of groups of ranges."""
    group = F.substring("range", 1, digits // 2)
    grouped = settle(per_range.withColumn("group", group), "mixing-sums")
    sums = grouped.groupBy(*_SOURCE, "group").agg(F.sum("in_range").alias("in_group"))
    groups = Window.partitionBy(*_SOURCE).orderBy("group")
    before = sums.withColumn("before", F.sum("in_group").over(groups) - F.col("in_group"))
    ranges = Window.partitionBy(*_SOURCE, "group").orderBy("range")
    inside = grouped.withColumn("inside", F.sum("in_range").over(ranges) - F.col("in_range"))
    joined = inside.join(before.drop("in_group"), [*_SOURCE, "group"])
    return joined.select(*_SOURCE, "range", (F.col("before") + F.col("inside")).alias("start"))


def cuts(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per source: size, target, whole epochs, and the spot its last epoch ends at.

    All rows of lower spots are taken in the last epoch, and ``fit`` of the ``rows`` of
    the last one. ``sized`` has source, size, place, doc_id and text_key.
    """
    spots = settle(
        _named(sized)
        .groupBy("source", *_SOURCE, *_SPOT)
        .agg(F.max("size").alias("size"), F.count("*").alias("rows")),
        "mixing-spots",
    )
    words = F.col("size") * F.col("rows")
    totals = spots.groupBy("source").agg(
        F.sum(words).alias("source_size"), F.count("*").alias("spots")
    )
    wanted = settle(targets(totals, weights, share, most), "mixing-targets")
    largest = wanted.agg(F.max("spots").alias("spots")).first().spots or 0
    digits = 0
    while 16**digits * range_rows < largest:
        digits += 1
    ranged = spots.withColumn("range", F.substring("place", 1, digits))
    per_range = ranged.groupBy(*_SOURCE, "range").agg(F.sum(words).alias("in_range"))
    starts = _starts(per_range, digits)
    epochs = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    planned = (
        _named(wanted)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select(*_SOURCE, "source_size", "target", "epochs", "rest")
    )
    # Only the range in which the rest ends has to be looked into spot by spot.
    last_range = settle(
        starts.join(planned, _SOURCE)
        .where(F.col("start") < F.col("rest"))
        .groupBy(*_SOURCE)
        .agg(F.max(F.struct("range", "start", "rest")).alias("r"))
        .select(*_SOURCE, "r.range", "r.start", "r.rest"),
        "mixing-ranges",
    )
    inside = Window.partitionBy(*_SOURCE, "range").orderBy(*_SPOT)
    left = F.col("rest") - F.col("start") - (F.sum(words).over(inside) - words)
    fit = F.when(F.col("size") > 0, F.floor(F.col("left") / F.col("size") + 0.5)).when(
        F.col("left") >= 0, F.col("rows")
    )
    last = (
        ranged.join(last_range, [*_SOURCE, "range"])
        .withColumn("left", left)
        .withColumn("fit", F.least(fit, F.col("rows")))
        .where("fit > 0")
        .groupBy(*_SOURCE)
        .agg(F.max(F.struct(*_SPOT, "fit", "rows")).alias("end"))
        .select(*_SOURCE, F.struct(*[f"end.{c}" for c in _SPOT]).alias("last"), "end.fit", "end.rows")
    )
    # All lower ranges are taken, even where no document of the last one fits.
    return planned.drop("rest").join(
        last_range.select(*_SOURCE, F.col("range").alias("last_range")).join(last, _SOURCE, "left"),
        _SOURCE,
        "left",
    )


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    return documents.select(
        "doc_id",
        "source",
        size_in_words().alias("size"),
        place(seed).alias("place"),
        text_key().alias("text_key"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of each last spot from 1, in the order of the table.

    Every part of the table counts its own rows; the counts, one for each part, give
    every part its first number. A spot that holds much of a source is in many parts.
    """
    marks = {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    placed = settle(rows.withColumns(marks), "mixing-last")
    counted = placed.groupBy(*_SOURCE, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*_SOURCE).orderBy("part")) - F.col("n")
    own = F.row_number().over(Window.partitionBy(*_SOURCE, "part").orderBy("at"))
    starts = counted.select(*_SOURCE, "part", before.alias("before"))
    numbered = placed.withColumn("own", own).join(starts, [*_SOURCE, "part"])
    return numbered.withColumn("nth", F.col("before") + F.col("own")).drop(
        "part", "at", "own", "before"
    )


def _with_copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Add source_size, target and how often each row is taken."""
    spot = F.struct(*_SPOT)
    joined = _named(rows).join(cut, _SOURCE)
    lower = F.coalesce(F.col("place") < F.col("last_range"), F.lit(False))
    lower |= F.coalesce(spot < F.col("last"), F.lit(False))
    end = F.coalesce(spot == F.col("last"), F.lit(False))
    # Only where a spot is taken in part does it matter which of its rows is which.
    if cut.where("fit < rows").isEmpty():
        taken = lower | end
    else:
        split = end & (F.col("fit") < F.col("rows"))
        whole = joined.where(~split).withColumn("nth", F.lit(0).cast("long"))
        joined = whole.unionByName(_numbered(joined.where(split)))
        taken = lower | (end & (F.col("nth") <= F.col("fit")))
    return joined.withColumn("copies", F.col("epochs") + taken.cast("long")).drop(
        *_SOURCE, "last_range", "last", "epochs", "fit", "rows", "nth"
    )


def _plan(documents: DataFrame, seed: int, plan: dict) -> tuple[DataFrame, DataFrame]:
    sized = settle(_sized(documents, seed), "mixing-sizes")
    return sized, settle(cuts(sized, **plan), "mixing-cuts")


def mix_report(documents: DataFrame, seed: int = SEED, **plan) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken of it."""
    sized, cut = _plan(documents, seed, plan)
    return _with_copies(sized, cut).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def mix(documents: DataFrame, seed: int = SEED, **plan) -> DataFrame:
    """The mixture: each document as often as it is taken, with its own columns.

    The cuts are one row per source; no text is shuffled to meet them while they are
    small enough to be broadcast by size.
    """
    _, cut = _plan(documents, seed, plan)
    rows = documents.select(
        "doc_id",
        "source",
        F.struct(*documents.columns).alias("row"),
        place(seed).alias("place"),
        text_key().alias("text_key"),
    )
    taken = _with_copies(rows, cut).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
