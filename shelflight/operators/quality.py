"""Data-quality jobs in place of constraints: keys, references, declared limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.schemas import DIGIT_LIMITS, FOREIGN_KEYS, PRIMARY_KEYS, TABLES, TEXT_LIMITS
from shelflight.star import Star


class KeyViolation(ValueError):
    """A table that must be unique on its key is not."""


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])


def key_report(rows: DataFrame, table: str) -> DataFrame:
    """One row: how far ``rows`` break the primary key of ``table``.

    Rows are counted per key with a map-side combine, then the counts are added.
    """
    keys = PRIMARY_KEYS[table]
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    null_key = _any_null(keys)
    repeated = ~null_key & (F.col("rows") > 1)
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_offered"),
        F.count_if(~null_key).alias("distinct_keys"),
        F.count_if(repeated).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("rows") - 1)), F.lit(0)).alias("surplus_rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("rows"))), F.lit(0)).alias("null_key_rows"),
    ).select(F.lit(table).alias("table_name"), "*")


def offered_rows(staging: DataFrame, table: str) -> DataFrame:
    """The rows the load offers to a table before any is dropped for its key.

    Every table but inventory is offered distinct rows.
    """
    rows = staging.select(*TABLES[table].fieldNames())
    return rows if table == "inventory" else rows.distinct()


def duplicate_keys(staging: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Key report of what the load offers to each table (all six unless named)."""
    reports = [key_report(offered_rows(staging, name), name) for name in tables or TABLES]
    return reduce(DataFrame.unionByName, reports)


def require_unique(rows: DataFrame, table: str) -> DataFrame:
    """Return ``rows`` if they honour the table's key; raise otherwise."""
    report = key_report(rows, table).first()
    if report["duplicated_keys"] or report["null_key_rows"]:
        raise KeyViolation(
            f"{table}: {report['duplicated_keys']} repeated keys, "
            f"{report['null_key_rows']} rows with a NULL key"
        )
    return rows


def _missing(references: DataFrame, parents: DataFrame, link: tuple[str, str, str]) -> DataFrame:
    child, parent, key = link
    used = (
        references.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("rows").alias("rows"))
    )
    missing = F.col("known").isNull()
    return (
        used.join(parents.select(key, F.lit(True).alias("known")), key, "left")
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_checked"),
            F.count_if(missing).alias("orphan_keys"),
            F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
        )
        .select(
            F.lit(child).alias("child_table"),
            F.lit(parent).alias("parent_table"),
            F.lit(key).alias("key_column"),
            "*",
        )
    )


def orphans(star: Star) -> DataFrame:
    """One row per foreign key: references checked and references without a parent.

    A child is counted once by all its references together. Each check starts
    from those counts, so a large child is read once and a frequent reference
    joins as a single row.
    """
    references = {
        child: star.table(child)
        .groupBy(*[key for name, _, key in FOREIGN_KEYS if name == child])
        .agg(F.count("*").alias("rows"))
        for child in dict.fromkeys(child for child, _, _ in FOREIGN_KEYS)
    }
    checks = [_missing(references[link[0]], star.table(link[1]), link) for link in FOREIGN_KEYS]
    return reduce(DataFrame.unionByName, checks)


def _whole_digits(amount: str) -> Column:
    return F.length(F.floor(F.abs(F.col(amount))).cast("string"))


def domain(staging: DataFrame) -> DataFrame:
    """One row per limited column: its limit, the longest value, rows over the limit.

    Text is measured in characters, amounts in digits before the point. One pass.
    """
    measures = {name: (limit, F.length(name)) for name, limit in TEXT_LIMITS.items()}
    measures |= {name: (limit, _whole_digits(name)) for name, limit in DIGIT_LIMITS.items()}
    summary = staging.agg(
        *[F.max(size).alias(f"{name}_max") for name, (_, size) in measures.items()],
        *[F.count_if(size > limit).alias(f"{name}_over") for name, (limit, size) in measures.items()],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(limit).alias("declared_limit"),
                F.col(f"{name}_max").alias("longest_value"),
                F.col(f"{name}_over").alias("rows_over_limit"),
            )
            for name, (limit, _) in measures.items()
        ]
    )
    return summary.select(F.inline(lines))
