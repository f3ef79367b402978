"""From raw file to star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight import snapshots
from shelflight.operators import normalize, quality
from shelflight.schemas import PRIMARY_KEYS, TABLES
from shelflight.sources import csv_records
from shelflight.star import Star
from shelflight.storage import read_star, settle, settled_tables, write_star


def load_star(
    spark: SparkSession,
    csv_path: str | list[str],
    folder: str,
    tolerant: bool = False,
    multiline: bool = False,
) -> Star:
    """Load raw records, normalise them, write the six tables below ``folder``.

    The text is parsed once, into a settled table that all others derive from. A line
    that does not fit the schema fails the load; a tolerant load sets it aside below
    ``folder``/rejected. A repeated inventory key fails either load. Nothing is
    written below ``folder`` before the checks, and the tables can be read back only
    when all of them are written. ``multiline``: quoted fields may hold line breaks.
    """
    with settled_tables(spark):
        rejected = None
        if tolerant:
            staging, rejected = csv_records.read_tolerant(spark, csv_path, multiline)
        else:
            staging = settle(csv_records.read_strict(spark, csv_path, multiline), "staging")
        quality.require_unique(staging, "inventory")
        if rejected is not None:
            rejected.write.parquet(f"{folder}/rejected")
        write_star(normalize.star(staging, unique=True), folder)
    return read_star(spark, folder)


_REPEATED, _NO_KEY = "repeated_key", "no_key"


def load_warnings(staging: DataFrame, explained: DataFrame) -> DataFrame:
    """What a tolerant load of first-wins tables passes over: counts by table, column and code.

    ``explained`` has the lines set aside, as ``read_explained`` returns them; they are
    counted under the table ``staging``, a line once for each of its wrong fields. Rows that
    are offered to a table and repeat a key, or have none, are counted under that table and
    the columns of its key. Counts are combined map-side; only counts above zero have a row.
    """
    lines = (
        explained.select(F.explode(csv_records.WARNINGS).alias("warning"))
        .groupBy("warning.column_name", "warning.code")
        .agg(F.count("*").alias("rows"))
        .select(F.lit("staging").alias("table_name"), "column_name", "code", "rows")
    )
    keys = F.create_map(
        *[F.lit(text) for name in TABLES for text in (name, ", ".join(PRIMARY_KEYS[name]))]
    )
    counts = F.expr(f"stack(2, '{_REPEATED}', surplus_rows, '{_NO_KEY}', null_key_rows) as (code, rows)")
    conflicts = quality.duplicate_keys(staging).select(
        "table_name", keys[F.col("table_name")].alias("column_name"), counts
    )
    return lines.unionByName(conflicts.where("rows > 0"))


def append_records(
    spark: SparkSession,
    csv_path: str | list[str],
    folder: str,
    tolerant: bool = False,
    ignore_inventory: bool = False,
    multiline: bool = False,
) -> tuple[Star, DataFrame]:
    """Load raw records into the snapshots of ``folder``, which the first load starts.

    Returns the star with them, and per table what was added and what was ignored. A
    tolerant load sets lines that do not fit the schema aside below ``folder``/rejected.
    """
    with settled_tables(spark):
        rejected = None
        if tolerant:
            staging, rejected = csv_records.read_tolerant(spark, csv_path, multiline)
        else:
            staging = settle(csv_records.read_strict(spark, csv_path, multiline), "staging")
        after, conflicts = snapshots.append(spark, staging, folder, ignore_inventory)
        if rejected is not None:
            rejected.write.parquet(f"{folder}/rejected/{after.number:08d}")
    return after.star(spark), conflicts
