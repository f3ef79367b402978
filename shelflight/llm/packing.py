"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are encoded and cut into pieces of at most the capacity: all but the
first piece are full, so only the first may be shorter. Pieces are packed in
rounds. In each round every partition packs its items best-fit, largest first;
bins that are nearly full are emitted, the underfull ones go to the next round as
items, dealt anew over so many partitions as their number needs, so leftovers of
several partitions meet in one that is no larger. The rounds end when one
partition of bounded size holds the leftovers, or when a round leaves about as many
items as it got (then no two leftovers fit together, or hardly any).

An item is a list of pieces; a bin has at most as many as its capacity, as every
piece has a token. The last round emits everything: no piece is dropped.

Nulls: a null text counts as empty; an empty text is the end id alone, one piece of
length one. Null and repeated doc_ids are packed like others. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import settle, slices, text_bytes
from shelflight.llm.tokens import END_ID, ids_with_end, tokenizer_path

CAPACITY = 2048
# A bin is nearly full when at most this share of it is empty.
SLACK = 1 / 256
# Items that a partition packs, about; a task's memory follows from it.
ITEMS = 50_000
# A round must leave fewer items by this share for another one to follow.
LEAST_SAVED = 1 / 16

_PIECE = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


# ---- pieces ----------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: a shorter one first, then full ones."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(
    batches: Iterable[pa.RecordBatch], path: str, capacity: int, end: int
) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        ids, counts = ids_with_end(text_bytes(batch.column("text")), path, end)
        data = memoryview(ids.astype("<u4").tobytes())
        rows, at = [], 0
        for row, n in enumerate(counts.tolist()):
            for number, (start, length) in enumerate(cut(n, capacity)):
                span = data[4 * (at + start) : 4 * (at + start + length)]
                rows.append((row, number, start, length, zlib.crc32(span)))
            at += n
        row, number, start, length, crc = map(np.array, zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(
    documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID
) -> DataFrame:
    """One row per piece of each document's ids and its end id."""
    read = documents.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    make = partial(_pieces, path=path or tokenizer_path(), capacity=capacity, end=end)
    return read.mapInArrow(make, _PIECE.format(kind=kind))


# ---- bins ------------------------------------------------------------------------


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin: largest item first, into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            waiting[left].append(at)
            rooms |= 1 << left
    return bins


def _pack(
    batches: Iterable[pa.RecordBatch], capacity: int, least: int
) -> Iterator[pa.RecordBatch]:
    """Items (size, order, members) of a partition as bins, full or to be packed on."""
    table = [batch for batch in batches if batch.num_rows]
    if not table:
        return
    items = pa.Table.from_batches(table).combine_chunks().sort_by(
        [("size", "ascending"), ("order", "ascending")]
    )
    sizes = items.column("size").to_pylist()
    orders = items.column("order").to_pylist()
    bins = best_fit(sizes, capacity)
    totals = np.array([sum(sizes[i] for i in found) for found in bins], np.int64)
    counts = np.array([len(found) for found in bins], np.int64)
    placed = items.column("members").combine_chunks().take(
        pa.array([i for found in bins for i in found], pa.int64())
    )
    # The members of a bin are those of its items, one after the other.
    inner = np.concatenate([[0], np.cumsum(placed.value_lengths().to_numpy(False))])
    offsets = inner[np.concatenate([[0], np.cumsum(counts)])]
    members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), placed.flatten())
    yield from pa.table(
        {
            "size": pa.array(totals),
            "order": pa.array([min(orders[i] for i in found) for found in bins], pa.int64()),
            "members": members,
            "full": pa.array(totals >= least),
        }
    ).to_batches(max_chunksize=2_000)


def _items(rows: DataFrame) -> DataFrame:
    """Pieces as items, dealt evenly by ``order``: by row number, as doc_ids may repeat or be null."""
    names = rows.columns
    return rows.select(
        F.col("length").alias("size"),
        F.xxhash64(F.monotonically_increasing_id()).alias("order"),
        F.array(F.struct(*names)).alias("members"),
    )


def packed(
    rows: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, items: int = ITEMS
) -> DataFrame:
    """Add sequence_id and offset to pieces, rows with a doc_id, piece and length.

    ``rows`` are read twice; settle them first.
    """
    names = rows.columns
    start = _items(rows)
    kind = start.schema["members"].dataType.simpleString()
    schema = f"size bigint, order bigint, members {kind}, full boolean"
    # Full pieces are bins already.
    done = [start.where(F.col("size") == capacity).select("members")]
    left = start.where(F.col("size") < capacity)
    count = left.count()
    rounds = 0
    while True:
        # By their number leftovers fill so many partitions, dealt anew each round.
        parts = max(1, -(-count // items))
        last = parts == 1
        least = 0 if last else int(capacity * (1 - slack))
        dealt = left.repartition(parts, F.xxhash64("order", F.lit(rounds)))
        bins = settle(
            dealt.mapInArrow(partial(_pack, capacity=capacity, least=least), schema), "packed-bins"
        )
        done.append(bins.where("full").select("members"))
        if last:
            break
        left = bins.where("not full").select("size", "order", "members")
        before, count = count, left.count()
        rounds += 1
        if count > before * (1 - LEAST_SAVED):
            # Merging saves nothing more: leftovers that are over half full pair with nothing.
            done.append(left.select("members"))
            break
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    numbered = bins.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select(
        "sequence_id",
        F.posexplode("members").alias("at", "m"),
        F.transform("members", lambda m: m["length"]).alias("lengths"),
    ).select(
        *[F.col(f"m.{name}").alias(name) for name in names],
        "sequence_id",
        F.aggregate(
            F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("bigint"), lambda a, b: a + b
        ).alias("offset"),
    )


def pack_documents(
    documents: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    slack: float = SLACK,
    items: int = ITEMS,
) -> DataFrame:
    """One row per piece of each document, with its sequence and its place there."""
    rows = settle(pieces(documents, path, capacity), "document-pieces")
    return packed(rows, capacity, slack, items)
