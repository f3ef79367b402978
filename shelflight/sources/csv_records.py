"""The raw stock-record file: comma-separated, quoted, one header line, 15 fields by position.

A quote inside a quoted field is doubled. An unquoted ``\\N`` is NULL; a blank
field is an empty text, and no number, date or flag. The flag is 0 or 1. A field is
one line, unless a load asks for ``multiline``: line breaks inside quotes then belong to
the field, and a file still is read by several tasks, see ``sources.multiline``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflight.schemas import CSV_RECORD, STAGING
from shelflight.sources.multiline import records
from shelflight.storage import settle

REJECTED = "rejected_line"
WARNINGS = "warnings"
# Why a line is set aside: it has not 15 fields; a number, date or flag is blank; it is none.
SHAPE, BLANK, UNREADABLE = "wrong_shape", "blank", "unreadable"
_BROKEN = "__broken_line"

# The file's format. Single-digit months and days are accepted.
_NULL = "\\N"
_FORMAT = {"header": "true", "sep": ",", "quote": '"', "escape": '"'}
_DATE = "yyyy-M-d"
_FLAG = "holiday_promotion"


def _fields(spark: SparkSession, path: str | list[str], multiline: bool) -> DataFrame:
    """The fields as texts, blank ones as empty texts, and a line with too few or too many."""
    texts = [T.StructField(f.name, T.StringType(), True) for f in CSV_RECORD]
    schema = T.StructType([*texts, T.StructField(_BROKEN, T.StringType(), True)])
    options = {**_FORMAT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    if multiline:
        # One record to a row; "multiLine" keeps the breaks inside quotes as they are.
        given = {**options, "multiLine": "true"}
        found = records(spark, path).where(F.trim("record") != "")
        ddl = ", ".join(f"{f.name} string" for f in schema)
        fields = found.select(F.from_csv("record", ddl, given).alias("f")).select("f.*")
    else:
        fields = spark.read.schema(schema).options(**options).csv(path)
    return fields.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in texts})


def _parsed(name: str, kind: T.DataType) -> Column:
    given = F.col(name)
    if isinstance(kind, T.StringType):
        return given
    if isinstance(kind, T.DateType):
        return F.expr(f"try_to_date({name}, '{_DATE}')")
    if name == _FLAG:
        return F.when(F.trim(given).isin("0", "1"), F.trim(given).cast("int"))
    return F.trim(given).try_cast(kind)


def _checked(fields: DataFrame, explained: bool = False) -> DataFrame:
    """The record's values, and the text of a line that does not fit the schema.

    ``explained``: also its (column, code), one for each wrong field. In a line of a wrong
    shape no field is told apart from another, so the shape is all that is named.
    """
    values, bad = {}, [F.col(_BROKEN).isNotNull()]
    wrong = []
    for field in CSV_RECORD:
        given = F.col(field.name) != _NULL
        parsed = _parsed(field.name, field.dataType)
        values[field.name] = F.when(given, parsed)
        if not isinstance(field.dataType, T.StringType):
            bad.append(given & parsed.isNull())
            code = F.when(F.trim(field.name) == "", BLANK).otherwise(UNREADABLE)
            reason = F.struct(F.lit(field.name).alias("column_name"), code.alias("code"))
            wrong.append(F.when(bad[-1], reason))
    refused = reduce(lambda a, b: a | b, bad)
    # A line that only has a wrong value is given back as its fields.
    line = F.coalesce(
        _BROKEN, F.to_csv(F.struct(*CSV_RECORD.fieldNames()), {**_FORMAT, "emptyValue": ""})
    )
    checked = fields.select(
        *[column.alias(name) for name, column in values.items()],
        F.when(refused, line).alias(REJECTED),
        *([F.col(_BROKEN)] if explained else []),
        *([F.array_compact(F.array(*wrong)).alias(WARNINGS)] if explained else []),
    )
    if not explained:
        return checked
    shape = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(SHAPE).alias("code")))
    told = F.when(F.col(_BROKEN).isNotNull(), shape).otherwise(F.col(WARNINGS))
    return checked.withColumn(WARNINGS, told).drop(_BROKEN)


def _staged(records: DataFrame) -> DataFrame:
    """Add the store-region key and bring the fields into staging order and types."""
    return records.withColumns(
        {
            "store_region_id": F.concat("store_id", F.lit("_"), "region"),
            _FLAG: F.col(_FLAG).cast("boolean"),
        }
    ).to(STAGING)


def read_strict(
    spark: SparkSession, path: str | list[str], multiline: bool = False
) -> DataFrame:
    """Staging rows; a line whose fields do not fit the schema fails the job that reads it."""
    parsed = _checked(_fields(spark, path, multiline))
    if multiline:
        # Else the check below would be pushed to lines that are no records of their own.
        parsed = settle(parsed, "parsed-records")
    refuse = F.raise_error(F.concat(F.lit("malformed record: "), F.col(REJECTED)))
    # As a filter: every job that reads a row checks all of its fields.
    fits = F.when(F.col(REJECTED).isNull(), F.lit(True)).otherwise(refuse.cast("boolean"))
    return _staged(parsed.where(fits).drop(REJECTED))


def read_tolerant(
    spark: SparkSession, path: str | list[str], multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Staging rows that fit the schema, and the text of the lines that do not.

    The parsed lines are settled, so both are read from one parse.
    """
    parsed = settle(_checked(_fields(spark, path, multiline)), "parsed-records")
    accepted = _staged(parsed.where(F.col(REJECTED).isNull()).drop(REJECTED))
    return accepted, parsed.where(F.col(REJECTED).isNotNull()).select(REJECTED)


def read_explained(
    spark: SparkSession, path: str | list[str], multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """As ``read_tolerant``, and with each line set aside its warnings.

    A warning is the column and a code: ``blank`` or ``unreadable``, or ``wrong_shape``
    without a column where the line has too few or too many fields. They are found in the
    parse that yields the rows.
    """
    parsed = settle(_checked(_fields(spark, path, multiline), explained=True), "parsed-records")
    accepted = _staged(parsed.where(F.col(REJECTED).isNull()).drop(REJECTED, WARNINGS))
    return accepted, parsed.where(F.col(REJECTED).isNotNull()).select(REJECTED, WARNINGS)


def write_records(staging: DataFrame, path: str) -> None:
    """Write staging rows in the raw file's format."""
    records = staging.withColumn(_FLAG, F.col(_FLAG).cast("int"))
    records.to(CSV_RECORD).write.options(**_FORMAT, nullValue=_NULL).csv(path)
