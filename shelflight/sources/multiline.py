"""Raw records whose quoted fields hold line breaks, read by byte ranges side by side.

A line break ends a record only outside quotes, and a quote inside quotes is doubled,
so a line starts a record if the quotes before it in its file are even in number.
A first read sums up each byte range in one row: whether its quotes are odd in number,
and the lines before its first record and from its last record on, both for a range
that begins outside quotes and for one that begins inside. Summed along each file, the
rows tell which of the two holds, and which pieces make up the records that cross
ranges. A second read puts together the records that lie within a range where they
are read, so no line is shuffled; the pieces of the others are few, one or two a range.

A quote inside an unquoted field counts like any other. A quote that is never closed
would make the rest of a file one record: a record of more than MAX_LINES lines fails
the job, whatever the load tolerates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelflight.storage import settle

MAX_LINES = 1_000

_SUMMARY = (
    "file bigint, block bigint, odd int, head bigint, head_text string,"
    " outside_start bigint, outside_lines bigint, outside_text string, outside_longest bigint,"
    " inside_start bigint, inside_lines bigint, inside_text string, inside_longest bigint"
)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The lines of a byte range that a batch holds, with its file and block."""
    for batch in batches:
        files, blocks = (batch.column(c).to_numpy() for c in ("file", "block"))
        # A task reads its ranges one after the other; a batch may hold the end of one.
        turns = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        edges = [0, *turns.tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:]):
            if first < last:
                yield (int(files[first]), int(blocks[first])), batch.slice(first, last - first)


def _text(parts: list[pa.Array]) -> str:
    return "\n".join(line for part in parts for line in part.to_pylist())


class _Side:
    """The records of a byte range that begins outside quotes (0), or inside (1)."""

    def __init__(self, inside: int, header: bool, most: int):
        self.inside = inside
        self.header = header
        self.most = most
        self.head = self.longest = 0
        self.start = -1
        self.lines = 0
        # Lines of the head, and of the record that is open; none once they are too many.
        self.first: list[pa.Array] = []
        self.parts: list[pa.Array] = []

    def _ended(self) -> None:
        if not (self.header and self.start == 0):
            self.longest = max(self.longest, self.lines)

    def _open(self, values: pa.Array) -> None:
        self.lines += len(values)
        if self.lines <= self.most:
            self.parts.append(values)
        else:
            self.parts = []

    def add(self, values: pa.Array, before: np.ndarray, line: int) -> None:
        starts = np.flatnonzero(before == self.inside)
        upto = int(starts[0]) if len(starts) else len(values)
        if self.start >= 0:
            self._open(values.slice(0, upto))
        else:
            self.head += upto
            self.first = [*self.first, values.slice(0, upto)] if self.head <= self.most else []
        if not len(starts):
            return
        if self.start >= 0:
            self._ended()
        gaps = np.diff(starts)
        if self.header and line + starts[0] == 0:
            gaps = gaps[1:]
        self.longest = max(self.longest, int(gaps.max(initial=0)))
        self.start, self.lines, self.parts = line + int(starts[-1]), 0, []
        self._open(values.slice(int(starts[-1])))

    def told(self, odd: int) -> list:
        """Start, number and text of the lines of the record open at the end, if any; the longest one."""
        if self.start < 0:
            return [None, None, None, self.longest]
        if odd == self.inside:
            self._ended()
            return [None, None, None, self.longest]
        text = _text(self.parts) if self.lines <= self.most else None
        return [self.start, self.lines, text, self.longest]


def _scan(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row for each byte range; texts of more than ``most`` lines are left out."""
    names = [column.split()[0] for column in _SUMMARY.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    kinds += [pa.int64(), pa.int64(), pa.string(), pa.int64()] * 2
    key, sides, line, before = None, [], 0, 0

    def summed() -> pa.RecordBatch:
        inside = sides[1]
        head = _text(inside.first) if inside.head <= most else None
        row = [*key, before, inside.head, head, *sides[0].told(before), *inside.told(before)]
        columns = [pa.array([value], kind) for value, kind in zip(row, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    for own, part in _runs(batches):
        if own != key:
            if key is not None:
                yield summed()
            # A file begins with its header, outside quotes.
            sides = [_Side(inside, own[1] == 0 and not inside, most) for inside in (0, 1)]
            key, line, before = own, 0, 0
        values = part.column("value")
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
        total = np.cumsum(odd) + before
        for side in sides:
            side.add(values, (total - odd) % 2, line)
        line += len(values)
        before = int(total[-1] % 2)
    if key is not None:
        yield summed()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line with its file and byte range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """Per byte range: whether it starts inside quotes, its pieces of records that cross its edges.

    ``head`` lines belong to the record that opened in the range ``of``; a record of
    ``tail`` lines opens in the range itself, if that is not null.
    """
    summed = settle(lines.mapInArrow(partial(_scan, most=MAX_LINES), _SUMMARY), "byte-ranges")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = summed.withColumn("opened", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)

    def own(name: str) -> Column:
        return F.when(F.col("opened") == 0, F.col(f"outside_{name}")).otherwise(F.col(f"inside_{name}"))

    found = found.select(
        "file",
        "block",
        "opened",
        "head",
        F.when(F.col("opened") == 1, F.col("head_text")).alias("head_text"),
        own("lines").alias("tail"),
        own("text").alias("tail_text"),
        own("longest").alias("longest"),
        ((F.col("block") == 0) & (own("start") == 0)).alias("header"),
    )
    opens = F.when(F.col("tail").isNotNull(), F.struct("block", "header"))
    return found.withColumn("of", F.last(opens, ignorenulls=True).over(earlier))


def _crossing(ranges: DataFrame) -> DataFrame:
    """(lines, record): the records that lie in several byte ranges, or that the file ends in."""
    opened = ranges.where("tail is not null").select(
        "file", F.col("block").alias("of"), "header", "block", F.col("tail").alias("n"),
        F.col("tail_text").alias("text"),
    )
    gone_on = ranges.where("opened = 1 and head > 0").select(
        "file", "of.block", "of.header", F.col("block").alias("at"), F.col("head").alias("n"),
        F.col("head_text").alias("text"),
    )
    pieces = F.array_sort(F.collect_list(F.struct(F.col("block"), F.col("text"))))
    return (
        opened.unionAll(gone_on)
        .toDF("file", "of", "header", "block", "n", "text")
        .where("not header")
        .groupBy("file", "of")
        .agg(F.sum("n").alias("lines"), F.array_join(pieces["text"], "\n").alias("record"))
        .select("lines", "record")
    )


def _within(
    batches: Iterable[pa.RecordBatch], opened: dict[tuple[int, int], int]
) -> Iterator[pa.RecordBatch]:
    """The records that start and end in one byte range, from its lines in order."""
    key, open_, header, before = None, None, False, 0

    def ended() -> Iterator[pa.RecordBatch]:
        # What is open inside quotes at the end of a range goes on in the next.
        if open_ is not None and not before and not header:
            yield _records(open_, np.array([0, len(open_)]))

    for own, part in _runs(batches):
        if own != key:
            yield from ended()
            if own not in opened:
                raise ValueError("the files changed while read")
            key, open_, before = own, None, opened[own]
            header = own[1] == 0
        values = part.column("value")
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
        total = np.cumsum(odd) + before
        starts = np.flatnonzero((total - odd) % 2 == 0)
        before = int(total[-1] % 2)
        if open_ is not None:
            starts = np.concatenate([[0], starts + len(open_)])
            values = pa.concat_arrays([open_, values])
        if len(starts):
            done = starts[1:] if header and len(starts) > 1 else starts
            header = header and len(starts) == 1
            yield _records(values, done)
            open_ = values.slice(int(starts[-1]))
    yield from ended()


def _records(values: pa.Array, edges: np.ndarray) -> pa.RecordBatch:
    """The lines between each edge and the next, joined."""
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
    return pa.RecordBatch.from_arrays([pc.binary_join(lists, "\n")], names=["record"])


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record): the text of every record below the header of each file, breaks included.

    The file is read twice: once here, to sum up its ranges, once for its lines. Both
    reads have to cut it into the same ranges; the second fails where they do not.
    """
    lines = _lines(spark, path)
    ranges = settle(_ranges(lines), "record-ranges")
    crossing = _crossing(ranges)
    _bounded(ranges.select(F.col("longest").alias("lines")).unionAll(crossing.select("lines")))
    # Three numbers for each range; to plan the read, the driver holds a range's path and bounds.
    # A join might shuffle the lines, which only in their order make records.
    opened = {(r.file, r.block): r.opened for r in ranges.select("file", "block", "opened").collect()}
    whole = lines.mapInArrow(partial(_within, opened=opened), "record string")
    found = whole.unionAll(crossing.select("record"))
    # A carriage return before the break that ends a record is not part of it.
    ended = F.endswith("record", F.lit("\r"))
    cut = F.left("record", F.length("record") - 1)
    return found.select(F.when(ended, cut).otherwise(F.col("record")).alias("record"))


def _bounded(sizes: DataFrame) -> None:
    """Fail if a record has more than ``MAX_LINES``."""
    longest = sizes.agg(F.max("lines")).first()[0] or 0
    if longest > MAX_LINES:
        raise ValueError(
            f"a record of {longest} lines: a quote is not closed, or MAX_LINES ({MAX_LINES}) is too low"
        )
