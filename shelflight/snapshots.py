"""A star that grows by loads.

Every load adds one part to each table. A snapshot lists the parts of all tables with
their rows and dates; it is written beside its place and moved there last, so readers
see either the whole load or none of it, and a load that breaks off leaves nothing but
files that no snapshot names. A load claims the snapshot it builds on: a second one at
the same time is refused.

A load also counts its own records by store-product and stock left; reports on
thresholds add up the counts of all loads and read no record. From MERGED_PARTS on, a
load merges the counts of those before it with its own.

A snapshot has a line for each table and load. That list is all the driver reads.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelflight.operators import normalize, profile, quality
from shelflight.schemas import NET_COUNTS, PRIMARY_KEYS, TABLES
from shelflight.star import Star
from shelflight.storage import laid_out, remove

_PARTS = "table_name string, path string, rows bigint, first_date date, last_date date"
_COUNTS = "net_counts"
_SCHEMAS = {**TABLES, _COUNTS: NET_COUNTS}
# Parts with counts that a snapshot has at most.
MERGED_PARTS = 16
_CONFLICTS = "table_name string, offered bigint, no_key bigint, repeated bigint, stored bigint, added bigint"


class LoadClaimed(RuntimeError):
    """Another load builds on the same snapshot, or broke off without giving it up."""


@dataclass(frozen=True)
class Part:
    table_name: str
    path: str
    rows: int
    first_date: dt.date | None
    last_date: dt.date | None

    def within(self, first: dt.date | None, last: dt.date | None) -> bool:
        """Whether rows of these dates can be in the part; dimensions have no dates."""
        if self.first_date is None or self.last_date is None:
            return True
        return (last is None or self.first_date <= last) and (
            first is None or self.last_date >= first
        )


@dataclass(frozen=True)
class Snapshot:
    folder: str
    number: int
    parts: tuple[Part, ...]

    def table(
        self,
        spark: SparkSession,
        name: str,
        first: dt.date | None = None,
        last: dt.date | None = None,
    ) -> DataFrame:
        """A table from the parts that can hold rows of these dates, and those rows only."""
        paths = [
            f"{self.folder}/{part.path}"
            for part in self.parts
            if part.table_name == name and part.rows and part.within(first, last)
        ]
        if not paths:
            return spark.createDataFrame([], _SCHEMAS[name])
        rows = spark.read.schema(_SCHEMAS[name]).parquet(*paths)
        if "record_date" in rows.columns:
            if first is not None:
                rows = rows.where(F.col("record_date") >= first)
            if last is not None:
                rows = rows.where(F.col("record_date") <= last)
        return rows

    def net_counts(self, spark: SparkSession) -> DataFrame:
        """The counts of all loads, to be added up; see ``operators.profile``."""
        return self.table(spark, _COUNTS)

    def star(
        self, spark: SparkSession, first: dt.date | None = None, last: dt.date | None = None
    ) -> Star:
        """The six tables, the facts from ``first`` to ``last`` if given."""

        def reader(name: str):
            return lambda: self.table(spark, name, first, last)

        return Star(**{name: reader(name) for name in TABLES})


# ---- files ----------------------------------------------------------------------


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    place, files = _place(spark, f"{folder}/snapshots")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(name) for name in names if name.isdigit())


def latest(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The newest snapshot, or one by its number; number 0 is the empty one."""
    numbers = _numbers(spark, folder)
    if number is None:
        number = numbers[-1] if numbers else 0
    if number == 0:
        return Snapshot(folder, 0, ())
    if number not in numbers:
        raise ValueError(f"{folder} has no snapshot {number}")
    listed = spark.read.schema(_PARTS).parquet(f"{folder}/snapshots/{number:08d}").collect()
    return Snapshot(folder, number, tuple(Part(**row.asDict()) for row in listed))


def _publish(spark: SparkSession, snapshot: Snapshot) -> None:
    target = f"{snapshot.folder}/snapshots/{snapshot.number:08d}"
    beside = f"{snapshot.folder}/snapshots/_{uuid.uuid4().hex}"
    rows = [
        (p.table_name, p.path, p.rows, p.first_date, p.last_date) for p in snapshot.parts
    ]
    spark.createDataFrame(rows, _PARTS).coalesce(1).write.parquet(beside)
    source, files = _place(spark, beside)
    if not files.rename(source, _place(spark, target)[0]):
        raise RuntimeError(f"could not publish {target}")


@contextmanager
def _claimed(spark: SparkSession, folder: str) -> Iterator[None]:
    """Only one load at a time: a file that must not exist yet says that one is under way."""
    place, files = _place(spark, f"{folder}/loading")
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if files.exists(place):
            raise LoadClaimed(f"{folder} is being loaded, see release()") from None
        raise error
    try:
        yield
    finally:
        files.delete(place, False)


def release(spark: SparkSession, folder: str) -> None:
    """Give up the claim of a load whose driver was killed."""
    remove(spark, f"{folder}/loading")


# ---- appending ------------------------------------------------------------------


def _offered(staging: DataFrame, name: str, ignore: bool) -> DataFrame:
    """The load's rows of a table, one for each key that it holds."""
    if name == "inventory" and ignore:
        keys = PRIMARY_KEYS[name]
        rows = normalize.inventory(staging)
        values = [c for c in rows.columns if c not in keys]
        return normalize.declared(normalize.first_wins(rows, keys, values), name)
    return normalize.star(staging, unique=not ignore).table(name)


def _added(
    spark: SparkSession, rows: DataFrame, before: Snapshot, name: str, dates: tuple
) -> DataFrame:
    """The rows whose key is not stored yet.

    Stored facts are read from the parts that overlap the load's dates, in those dates
    only; a load of new dates reads none.
    """
    keys = PRIMARY_KEYS[name]
    dates = dates if "record_date" in keys else (None, None)
    if not any(p.table_name == name and p.rows and p.within(*dates) for p in before.parts):
        return rows
    stored = before.table(spark, name, *dates).select(*keys)
    return rows.join(stored, keys, "left_anti")


def _write_part(rows: DataFrame, snapshot: Snapshot, name: str) -> Part:
    """Write a part; its rows and dates are counted on the way."""
    path = f"parts/{name}/{snapshot.number:08d}-{uuid.uuid4().hex}"
    dated = "record_date" in rows.columns
    date = F.col("record_date") if dated else F.lit(None).cast("date")
    seen = Observation()
    counted = laid_out(rows, name).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
    counted.write.parquet(f"{snapshot.folder}/{path}")
    return Part(name, path, **seen.get)


def _count(spark: SparkSession, before: Snapshot, after: Snapshot, inventory: Part) -> list[Part]:
    """The parts with counts: those so far and one of the new records, or a single one."""
    kept = [part for part in before.parts if part.table_name == _COUNTS]
    own = Snapshot(after.folder, after.number, (inventory,))
    counts = profile.net_counts(own.table(spark, "inventory"))
    if len(kept) + 1 >= MERGED_PARTS:
        counts = profile.merge_counts(before.net_counts(spark).unionByName(counts))
        kept = []
    return [*kept, _write_part(counts.to(NET_COUNTS), after, _COUNTS)]


def append(
    spark: SparkSession, staging: DataFrame, folder: str, ignore_inventory: bool = False
) -> tuple[Snapshot, DataFrame]:
    """Add settled staging rows to the star in ``folder`` and publish the next snapshot.

    A row whose key is stored, or repeats in the load, is ignored: the stored one wins,
    then the first of the load. Not so in the inventory, where a repeated or NULL key
    fails the load, unless ``ignore_inventory``. Nothing is published then.

    Also returns, per table, the rows offered, those without a key, those that repeat a
    key of the load, those whose key was stored, and those added.
    """
    with _claimed(spark, folder):
        before = latest(spark, folder)
        after = Snapshot(folder, before.number + 1, ())
        reports = {row.table_name: row for row in quality.duplicate_keys(staging).collect()}
        found = reports["inventory"]
        if not ignore_inventory and (found.duplicated_keys or found.null_key_rows):
            raise quality.KeyViolation(
                f"inventory: {found.duplicated_keys} repeated keys, "
                f"{found.null_key_rows} rows with a NULL key"
            )
        span = staging.agg(F.min("record_date"), F.max("record_date")).first()
        parts, conflicts = [], []
        for name in TABLES:
            rows = _offered(staging, name, ignore_inventory)
            part = _write_part(_added(spark, rows, before, name, tuple(span)), after, name)
            report = reports[name]
            stored = report.distinct_keys - part.rows
            if name == "inventory" and stored and not ignore_inventory:
                raise quality.KeyViolation(f"inventory: {stored} keys are stored already")
            parts.append(part)
            conflicts.append(
                (name, report.rows_offered, report.null_key_rows, report.surplus_rows, stored, part.rows)
            )
        inventory = next(part for part in parts if part.table_name == "inventory")
        stored = [part for part in before.parts if part.table_name != _COUNTS]
        parts += _count(spark, before, after, inventory)
        after = Snapshot(folder, after.number, (*stored, *parts))
        _publish(spark, after)
    return after, spark.createDataFrame(conflicts, _CONFLICTS)
