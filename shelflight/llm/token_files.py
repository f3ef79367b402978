"""Token ids in files: canonical length-limited Huffman codes, decoded by table.

Layout of a written folder:

* ``codes``: the code length of every id that occurs. Codes are canonical, so the
  lengths say all. Lengths come from the counts over the whole corpus by
  package-merge, under a limit that keeps the decoding table small.
* ``segments/shard=N``: documents in ascending doc_id order. Shards are ranges of
  doc_ids; a row is a run of whole documents: doc_ids, numbers of ids, the shard's
  ids before it, the code bits, and the bit offset of every block of ids.

A shard's ids end where its last segment does; absolute starts follow from that.

Blocks start at known bits and decode independently: a task decodes all blocks of
several segments in step, one table look-up per id. A segment ends with the
document that fills it, so one very long document makes one long segment.

Nulls: a null text counts as empty and is the end id alone. Null doc_ids come
first; rows that share a doc_id follow each other, and may lie in several shards. An empty table makes empty
files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelflight.llm.common import ragged, settle, slices, text_bytes, text_key
from shelflight.llm.tokens import END_ID, binary_rows, ids_with_end, library, tokenizer_path
from shelflight.storage import fresh_path

# Ids per block and, about, per segment; segments decoded in step.
BLOCK = 1024
SEGMENT = 1 << 16
SEGMENTS_IN_STEP = 24
# Codes are no longer than this unless there are too many ids for it.
LIMIT = 16


# ---- codes -----------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    packages = np.empty(0, np.int64)
    leaf_at = []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        merged = np.argsort(both, kind="stable")
        leaf_at.append(merged < n)
        weights = both[merged]
        even = len(weights) // 2 * 2
        packages = weights[:even:2] + weights[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaf_at):
        found = int(is_leaf[:take].sum())
        lengths[:found] += 1
        take = 2 * (take - found)
    result = np.empty(n, np.int64)
    result[order] = lengths
    return result


class Codes:
    """Canonical codes of ids and the table that decodes them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        self.bits = int(lengths.max()) if len(ids) else 1
        # Codes in this order are the running sum of 2^-length, in units of 2^-bits.
        widths = np.left_shift(1, self.bits - lengths)
        first = np.cumsum(widths) - widths
        top = int(ids.max()) + 1 if len(ids) else 1
        self.length = np.zeros(top, np.int64)
        # Each code in the highest bits of a word.
        self.code = np.zeros(top, np.uint64)
        self.length[ids] = lengths
        self.code[ids] = first.astype(np.uint64) << np.uint64(64 - self.bits)
        # Each entry of the table: the id and, in the lowest byte, the bits it takes.
        self.table = np.ones(1 << self.bits, np.uint64)
        entries = (ids.astype(np.uint64) << np.uint64(8)) | lengths.astype(np.uint64)
        self.table[: int(widths.sum())] = np.repeat(entries, widths)


def encode(ids: np.ndarray, codes: Codes, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, highest first, and the bit at which each block starts."""
    ids = ids.astype(np.intp)
    lengths, values = codes.length[ids], codes.code[ids]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word, bit = starts >> 6, starts & 63
    high = values >> bit.view(np.uint64)
    # A code is shorter than a word, so some code starts in every word but perhaps the last.
    change = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[change]] = np.add.reduceat(high, change)
    split = np.flatnonzero(bit + lengths > 64)  # the rest of these runs into the next word
    words[word[split] + 1] |= values[split] << (64 - bit[split]).view(np.uint64)
    return words.astype(">u8").tobytes()[: -(-int(ends[-1]) // 8)], starts[::block]


def decode(
    payloads: list[bytes], offsets: list[np.ndarray], sizes: np.ndarray, codes: Codes, block: int
) -> np.ndarray:
    """Ids of several segments: every block of all of them goes forward one id at a time."""
    padded = [payload + bytes(-len(payload) % 4) for payload in payloads]
    before = np.cumsum([0, *map(len, padded)])[:-1] * 8
    spare = bytes(4 * (block * codes.bits // 32 + 2))
    words = np.frombuffer(b"".join([*padded, spare]), ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.concatenate([o + b for o, b in zip(offsets, before, strict=True)])
    lanes = np.concatenate([_block_sizes(int(n), block) for n in sizes])
    found = np.empty((block, len(at)), np.uint32)
    shift, mask = 64 - codes.bits, np.uint64((1 << codes.bits) - 1)
    last = len(pairs) - 1
    for step in range(int(lanes.max(initial=0))):
        window = pairs[np.minimum(at >> 5, last)]
        entry = codes.table[(window >> (shift - (at & 31)).astype(np.uint64)) & mask]
        found[step] = entry >> np.uint64(8)
        at += (entry & np.uint64(255)).astype(np.int64)
    columns = np.repeat(np.arange(len(lanes)), lanes)
    rows = ragged(np.zeros(len(lanes), np.int64), lanes)
    return found[rows, columns]


def _block_sizes(n: int, block: int) -> np.ndarray:
    sizes = np.full(-(-n // block), block, np.int64)
    if n % block:
        sizes[-1] = n % block
    return sizes


# ---- writing ---------------------------------------------------------------------


def _id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if library(path).get_vocab_size() <= 1 << 16 else "<u4")


def _ids(batches: Iterable[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    kind = _id_type(path)
    for batch in slices(batches, "text"):
        ids, counts = ids_with_end(text_bytes(batch.column("text")), path, end)
        columns = [
            batch.column("doc_id"),
            batch.column("text_key"),
            pa.array(counts, pa.int64()),
            binary_rows(ids.astype(kind), counts),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "ids"])


def _count_ids(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    kind, total = _id_type(path), np.zeros(library(path).get_vocab_size() + 1, np.int64)
    for batch in batches:
        found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
        total[: len(found)] += found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"]
    )


def _segments(
    batches: Iterable[pa.RecordBatch], path: str, codes: Codes, segment: int, block: int
) -> Iterator[pa.RecordBatch]:
    """Runs of documents of one shard, encoded. A task is a shard."""
    kind = _id_type(path)
    shard, start = TaskContext.get().partitionId(), 0
    waiting: list[dict] = []
    held = 0

    def given() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(row["ids"] for row in waiting), kind)
        payload, offsets = encode(ids, codes, block)
        columns = [
            pa.array([shard], pa.int32()),
            pa.array([start], pa.int64()),
            pa.array([[row["doc_id"] for row in waiting]], pa.list_(doc_kind)),
            pa.array([[row["n"] for row in waiting]], pa.list_(pa.int64())),
            pa.array([offsets.tolist()], pa.list_(pa.int64())),
            pa.array([payload], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_SEGMENT)

    for batch in batches:
        doc_kind = batch.schema.field("doc_id").type
        for row in batch.to_pylist():
            waiting.append(row)
            held += row["n"]
            if held >= segment:
                yield given()
                start += held
                waiting, held = [], 0
    if waiting:
        yield given()


_SEGMENT = ["shard", "start", "doc_ids", "counts", "blocks", "payload"]


def write_ids(
    documents: DataFrame,
    folder: str,
    path: str | None = None,
    end: int = END_ID,
    segment: int = SEGMENT,
    block: int = BLOCK,
) -> None:
    """Encode the documents' texts and write their ids below ``folder``."""
    path = path or tokenizer_path()
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", text_key().alias("text_key"), "text")
    schema = f"doc_id {kind}, text_key bigint, n bigint, ids binary"
    encoded = texts.mapInArrow(partial(_ids, path=path, end=end), schema)
    # Rows of one doc_id are told apart by a number, so that they spread over shards.
    ids = settle(encoded.withColumn("row", F.monotonically_increasing_id()), "document-ids")
    counts = ids.select("ids").mapInArrow(partial(_count_ids, path=path), "id bigint, n bigint")
    # At most one row per id of the vocabulary.
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    used = np.array([row.id for row in rows], np.int64)
    limit = max(LIMIT, int(len(used)).bit_length() + 2)
    lengths = code_lengths(np.array([row.n for row in rows], np.int64), limit)
    pairs = list(zip(used.tolist(), lengths.tolist(), strict=True))
    table = spark.createDataFrame(pairs, "id bigint, length bigint")
    table.coalesce(1).write.parquet(f"{folder}/codes")
    make = partial(
        _segments, path=path, codes=Codes(used, lengths), segment=segment, block=block
    )
    schema = (
        f"shard int, start bigint, doc_ids array<{kind}>, counts array<bigint>, "
        "blocks array<bigint>, payload binary"
    )
    segments = _ordered(ids).select("doc_id", "n", "ids").mapInArrow(make, schema)
    segments.write.option("compression", "none").partitionBy("shard").parquet(f"{folder}/segments")


def _ordered(ids: DataFrame) -> DataFrame:
    """By doc_id; the ranges also cut between rows that share one."""
    order = ["doc_id", "text_key", "row"]
    return ids.repartitionByRange(*order).sortWithinPartitions(*order)


# ---- reading ---------------------------------------------------------------------


def _documents(
    batches: Iterable[pa.RecordBatch], codes: Codes, block: int
) -> Iterator[pa.RecordBatch]:
    """Every document's ids, from segments decoded a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SEGMENTS_IN_STEP):
            part = batch.slice(at, SEGMENTS_IN_STEP)
            counts = part.column("counts")
            sizes = np.array([sum(found) for found in counts.to_pylist()], np.int64)
            offsets = [np.array(found, np.int64) for found in part.column("blocks").to_pylist()]
            ids = decode(part.column("payload").to_pylist(), offsets, sizes, codes, block)
            each = counts.flatten().to_numpy()
            docs = counts.value_lengths().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), docs)
            ends = np.cumsum(each)
            base = part.column("start").to_numpy() - (np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("shard").take(pa.array(owner)),
                    pa.array(base[owner] + ends - each),
                    part.column("doc_ids").flatten(),
                    pa.array(each),
                    binary_rows(ids.astype("<u4"), each),
                ],
                names=["shard", "start", "doc_id", "n", "ids"],
            )


def _checksums(batches: Iterable[pa.RecordBatch], codes: Codes, block: int):
    for batch in _documents(batches, codes, block):
        sums = [zlib.crc32(value.as_buffer()) for value in batch.column("ids")]
        columns = [*batch.columns[:4], pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "start", "doc_id", "n", "crc"])


def _read(spark: SparkSession, folder: str, make, last: str, block: int) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/codes").collect()  # at most one per id
    codes = Codes(
        np.array([row.id for row in rows], np.int64), np.array([row.length for row in rows], np.int64)
    )
    if not rows:
        none = "shard int, start bigint, doc_ids array<bigint>, counts array<bigint>, "
        segments = spark.createDataFrame([], none + "blocks array<bigint>, payload binary")
    else:
        segments = spark.read.parquet(f"{folder}/segments").select(*_SEGMENT)
    # The last segment of a shard ends where the shard does.
    words = F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, n: total + n)
    shards = segments.groupBy("shard").agg(F.max(F.col("start") + words).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    bases = shards.select("shard", before.alias("base"))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"shard int, start bigint, doc_id {kind}, n bigint, {last}"
    read = segments.mapInArrow(partial(make, codes=codes, block=block), schema)
    return read.join(bases, "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_ids(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n and ids (little-endian unsigned 32-bit) of every document."""
    found = _read(spark, folder, _documents, "ids binary", block)
    return found.select("doc_id", "start", "n", "ids")


def checksums(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    found = _read(spark, folder, _checksums, "crc bigint", block)
    return found.select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' ids to the shared folder and describe what is read back."""
    spark = documents.sparkSession
    folder = fresh_path(spark, "token-files")
    write_ids(documents, folder, path)
    return checksums(spark, folder)
