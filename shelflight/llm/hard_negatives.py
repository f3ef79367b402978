"""Hard negatives: integer scores of anchors and rows by Strassen's products, then heaps.

Anchors (the rows of a stated query set) are taken in blocks of bounded size; a block
travels with the tasks. A task multiplies the block with tiles of its rows: each
product is split into seven of half the size, with zeros added where a side is odd,
down to small leaves. All numbers are int64 and only added, subtracted and multiplied,
so scores are exact. Heaps per anchor keep its best rows of the same label; merged
over the tasks they give its positives. A second pass keeps, per anchor and positive,
a heap of the best rows of another label within the window of the positive's score.

Rows with a null label, a null vector, or a null or non-finite component take no part;
nor does a vector whose scaled square length is 2^56 or more, as its scores might not
fit a long. Shorter vectors count as filled up with zeros. Rows that repeat vec_id,
label and scaled vector are one row; rows that share a vec_id only are different rows,
and each is an anchor if its vec_id is. A row without vec_id is no anchor and comes
last among ties (so does vec_id 2^63-1, which stands for it). Empty tables and anchors
without positives or negatives give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import settle
from shelflight.storage import fresh_path

POSITIVES = 5
NEGATIVES = 5
SCALE = 256.0
# A negative's score lies between these percentages of the positive's.
WINDOW = (80, 100)
# Bytes of anchors in a block, and what heaps of an anchor come to.
BLOCK_BYTES = 8 << 20
_ANCHOR_BYTES = 16 * POSITIVES * (NEGATIVES + 1)
TILE_ANCHORS = 512
TILE_ROWS = 2048
# Rows of a file of the prepared table: a task reads one or more whole files.
_FILE_ROWS = 8192
# Sides up to this are multiplied as they are.
LEAF = 32

_LARGEST = 2.0**56
_NO_ID = np.iinfo(np.int64).max
_LOWEST = -(1 << 62)

_FOUND = "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
_RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint,"
    " negative_score bigint"
)


# ---- products -------------------------------------------------------------------


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b in int64: seven half-sized products, as long as every side is above ``leaf``."""
    if min(*a.shape, b.shape[1]) <= leaf:
        return a @ b
    n, m = a.shape[0], b.shape[1]
    a = np.pad(a, [(0, side % 2) for side in a.shape]) if n % 2 or a.shape[1] % 2 else a
    b = np.pad(b, [(0, side % 2) for side in b.shape]) if m % 2 or b.shape[0] % 2 else b
    h, k, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    b11, b12, b21, b22 = b[:k, :w], b[:k, w:], b[k:, :w], b[k:, w:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    product = np.empty((2 * h, 2 * w), np.int64)
    product[:h, :w] = p1 + p4 - p5 + p7
    product[:h, w:] = p3 + p5
    product[h:, :w] = p2 + p4
    product[h:, w:] = p1 - p2 + p3 + p6
    return product[:n, :m]


# ---- heaps ----------------------------------------------------------------------


class Heaps:
    """The best ``size`` entries of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.score = np.full((slots, size), _LOWEST, np.int64)
        self.id = np.full((slots, size), _NO_ID, np.int64)

    def floor(self) -> np.ndarray:
        """The score below which nothing can enter a slot any more."""
        return self.score[:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge entries, or the entries of other heaps, into the slots."""
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, self.size), slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        best = rank < self.size
        self.score[slot[best], rank[best]] = score[best]
        self.id[slot[best], rank[best]] = ids[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, rank = np.nonzero(self.score > _LOWEST)
        return slot, self.score[slot, rank], self.id[slot, rank]


def _best(scores: np.ndarray, allowed: np.ndarray, floor: np.ndarray, size: int) -> tuple:
    """Where scores may be among the best ``size`` of their row, ties included."""
    allowed = allowed & (scores >= floor[:, None])
    if scores.shape[1] > size and np.count_nonzero(allowed) > 2 * size * len(scores):
        at = scores.shape[1] - size
        kept = np.where(allowed, scores, _LOWEST)
        allowed &= scores >= np.partition(kept, at, axis=1)[:, at, None]
    return np.nonzero(allowed)


# ---- tiles ----------------------------------------------------------------------


@dataclass
class Tile:
    """Rows as arrays: vec_id, label and the vectors, filled up with zeros."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def part(self, at: int, rows: int) -> Tile:
        cut = slice(at, at + rows)
        return Tile(self.ids[cut], self.labels[cut], self.vectors[cut])

    def wide(self, width: int) -> np.ndarray:
        lacking = width - self.vectors.shape[1]
        return np.pad(self.vectors, ((0, 0), (0, lacking))) if lacking else self.vectors


def _tile(rows: pa.RecordBatch | pa.Table) -> Tile:
    vectors = rows.column("vector")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        filled = values.reshape(len(sizes), width)
    else:
        filled = np.zeros((len(sizes), width), np.int64)
        filled[np.arange(width) < sizes[:, None]] = values
    ids = rows.column("vec_id").fill_null(_NO_ID).to_numpy()
    return Tile(ids, rows.column("label").to_numpy(), filled)


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[Tile]:
    for batch in batches:
        whole = _tile(batch)
        for at in range(0, batch.num_rows, TILE_ROWS):
            yield whole.part(at, TILE_ROWS)


def _scores(anchors: Tile, rows: Tile) -> np.ndarray:
    width = max(anchors.vectors.shape[1], rows.vectors.shape[1])
    return strassen(anchors.wide(width), rows.wide(width).T)


def _selves(anchors: Tile, rows: Tile, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a row is the anchor itself: the same vec_id, label and vector."""
    a, r = np.nonzero(anchors.ids[:, None] == rows.ids[None, :])
    width = max(anchors.vectors.shape[1], rows.vectors.shape[1])
    same = (anchors.wide(width)[a] == rows.wide(width)[r]).all(axis=1)
    same &= anchors.labels[a] == rows.labels[r]
    return a[same], r[same]


def _pairs(anchors: Tile, rows: Tile) -> Iterator[tuple[int, Tile, np.ndarray]]:
    for at in range(0, len(anchors.ids), TILE_ANCHORS):
        part = anchors.part(at, TILE_ANCHORS)
        yield at, part, _scores(part, rows)


def _emit(heaps: Heaps, named: Iterable[np.ndarray]) -> pa.RecordBatch:
    slot, score, ids = heaps.entries()
    columns = [slot, *[column[slot] for column in named], ids, score]
    names = ["slot", "anchor_id", "positive_id", "positive_score", "id", "score"]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)


def _positives(batches: Iterable[pa.RecordBatch], anchors: Tile) -> Iterator[pa.RecordBatch]:
    heaps = Heaps(len(anchors.ids), POSITIVES)
    for rows in _tiles(batches):
        for at, part, scores in _pairs(anchors, rows):
            alike = part.labels[:, None] == rows.labels[None, :]
            alike[_selves(part, rows, scores)] = False
            floor = heaps.floor()[at : at + len(part.ids)]
            a, r = _best(scores, alike, floor, POSITIVES)
            heaps.offer(a + at, scores[a, r], rows.ids[r])
    none = np.zeros(len(anchors.ids), np.int64)
    yield _emit(heaps, [anchors.ids, none, none])


def _negatives(
    batches: Iterable[pa.RecordBatch], anchors: Tile, positives: Heaps
) -> Iterator[pa.RecordBatch]:
    heaps = Heaps(len(anchors.ids) * POSITIVES, NEGATIVES)
    known = positives.score > _LOWEST
    highest = np.where(known, positives.score, 0)
    # The least whole number at or above that share of the positive's score.
    lowest = -((-WINDOW[0] * highest) // WINDOW[1])
    for rows in _tiles(batches):
        for at, part, scores in _pairs(anchors, rows):
            other = part.labels[:, None] != rows.labels[None, :]
            mine = np.arange(at, at + len(part.ids))
            for nth in range(POSITIVES):
                slots = mine * POSITIVES + nth
                within = other & known[mine, nth, None]
                within &= scores <= highest[mine, nth, None]
                floor = np.maximum(heaps.floor()[slots], lowest[mine, nth])
                a, r = _best(scores, within, floor, NEGATIVES)
                heaps.offer(slots[a], scores[a, r], rows.ids[r])
    anchor_ids = np.repeat(anchors.ids, POSITIVES)
    yield _emit(heaps, [anchor_ids, positives.id.ravel(), positives.score.ravel()])


# ---- jobs -----------------------------------------------------------------------


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, each different row once."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10)
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(
            "vec_id",
            F.coalesce(moved, F.col("label").cast("long")).alias("label"),
            scaled.alias("vector"),
        )
        .where(size < _LARGEST)
        .distinct()
    )


def _top(found: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks merged; each task's rows are ranked before they are sent."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _mined(rows: DataFrame, anchors: Tile) -> DataFrame:
    """Negatives of a block of anchors."""
    best = _top(rows.mapInArrow(partial(_positives, anchors=anchors), _FOUND), POSITIVES)
    merged = best.select("slot", "score", "id").toArrow()
    positives = Heaps(len(anchors.ids), POSITIVES)
    positives.offer(*[merged.column(c).to_numpy() for c in ("slot", "score", "id")])
    scan = partial(_negatives, anchors=anchors, positives=positives)
    found = _top(rows.mapInArrow(scan, _FOUND), NEGATIVES)

    def named(column: str) -> Column:
        return F.when(F.col(column) != int(_NO_ID), F.col(column))

    return found.select(
        "anchor_id",
        named("positive_id").alias("positive_id"),
        "rank",
        named("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """Per anchor and positive the first negatives within the window.

    Anchors are the rows whose vec_id is divisible by ``every``; all rows are
    candidates. Each block of anchors is written before the next one starts.
    """
    spark = embeddings.sparkSession
    rows = settle(prepared(embeddings), "vectors")
    count = rows.count()
    rows = settle(rows.repartition(max(1, -(-count // _FILE_ROWS))), "vectors")
    chosen = rows.where(F.col("vec_id") % every == 0)
    size = chosen.agg(F.sum(F.size("vector") * 8 + _ANCHOR_BYTES).alias("size")).first().size
    if not size:
        return spark.createDataFrame([], _RESULT)
    blocks = -(-size // BLOCK_BYTES)
    path = fresh_path(spark, "negatives")
    block = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))
    for number in range(blocks):
        anchors = _tile(chosen.where(block == number).toArrow())
        _mined(rows, anchors).write.parquet(f"{path}/block={number}")
    return spark.read.schema(f"{_RESULT}, block int").parquet(path).drop("block")
