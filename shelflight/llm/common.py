"""Helpers of the operators: bounded slices of texts, written intermediates, kept rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.storage import fresh_path

# Code points that separate words everywhere here, as inside a regular expression's
# brackets. Python's bytes.split() without an argument splits at exactly these.
BLANK_CLASS = r"\x20\x09-\x0D"

# Text bytes that a task holds as Python objects at a time.
SLICE_BYTES = 2 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(table: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The copy cuts the lineage and survives lost executors. The shuffle files of
    the job that wrote it are of no use afterwards and go when the job ends.
    """
    spark = table.sparkSession
    path = fresh_path(spark, label)
    with _setting(spark, _CLEANUP, "true"):
        table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def lowered(text: bytes) -> bytes:
    """A-Z to a-z, all other bytes as they are."""
    return text.translate(_LOWER)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of ``column`` come to about SLICE_BYTES.

    A single longer text stays whole and makes a slice of its own.
    """
    for batch in batches:
        sizes = batch.column(column).cast(pa.binary()).fill_null(b"")
        ends = np.cumsum([len(size.as_buffer()) for size in sizes])
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; empty runs sum to zero."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def text_key(text: str = "text") -> Column:
    """With doc_id, tells rows apart that share one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def only_rows(documents: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``documents`` named by ``keepers`` (doc_id, text_key), each once.

    Rows that repeat one doc_id with the same text are copies; one of them stays.
    """
    # The row as one struct: no column of it has the name of a helper.
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    marked = rows.select("row", F.col("row.doc_id").alias("id"), text_key("row.text").alias("key"))
    names = keepers.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    kept = marked.join(names, same, "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")
