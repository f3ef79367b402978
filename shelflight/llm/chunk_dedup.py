"""Repeated passages by content-defined chunking.

A gear rolling hash runs over a text's bytes: each byte shifts the hash by one bit
and adds the byte's random number, so in 16 bits it depends on the last 16 bytes
alone. A chunk ends where the upper bits are zero. Ends follow from content, so an
insertion moves the chunks after it but does not change them. A chunk longer than
a largest size, as in text that repeats a word without an end in it, is divided
where its hash is smallest, which is content as well.

A chunk's digest that occurs in more than one document is a repeat, of the smallest
doc_id that has it. Neighbouring repeats of a document make one passage, which
counts from a least size on: single chunks repeat by chance. A passage of fewer
bytes is a seed: it is extended byte by byte from its longest chunk, against the first
and the last document that has this chunk, and counts if the longer of both matches
has the least size. Four passes read the texts. The first combines digests map-side and
keeps those of several documents; the second joins the chunks to them, where adaptive
execution splits a digest that very many documents share; the third reads marks of the
bytes beside the chunks of seeds, there and in the documents they are held against, which
tell most seeds that cannot be extended; the fourth reads the bytes beside the others.

Nulls: a null or empty text has no chunks. Rows that share a doc_id are one
document, of which equal chunks at equal places count once; null doc_ids are
ignored by the search and kept by ``drop_repeats``. An empty table gives an empty
result. Other columns are ignored, and kept by ``drop_repeats``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import settle, slices, text_bytes

# The hash's width in bits and bytes seen; one place in 2^MASK_BITS ends a chunk.
WIDTH = 16
MASK_BITS = 5
LONGEST = 256
# Least distance of the ends that divide such a chunk.
APART = 32
# Bytes of neighbouring repeats that make a passage.
LEAST = 128
GEAR_SEED = 20_011


def gear(seed: int = GEAR_SEED) -> np.ndarray:
    """A random number for every byte, the same in every process; zero for byte zero."""
    table = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << WIDTH, 256, np.uint16)
    table[0] = 0
    return table


_GEAR = gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash after each byte: sum of gear[b[i - j]] << j, by doubling the window."""
    value = _GEAR[data]
    span = 1
    while span < WIDTH:
        value[span:] = value[span:] + (value[:-span] << np.uint16(span))
        span *= 2
    return value


def chunk_ends(texts: list[bytes]) -> list[np.ndarray]:
    """Where the chunks of each text end; never inside a character."""
    # Zero bytes between the texts empty the window, so texts do not affect each other.
    gap = bytes(WIDTH)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    value = rolling(data)
    # An end after a byte is possible if the next one does not continue a character.
    possible = np.append(data[1:] & 0xC0 != 0x80, True)
    found = np.flatnonzero((value >> np.uint16(WIDTH - MASK_BITS) == 0) & possible) + 1
    sizes = np.array([len(text) for text in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + WIDTH)[:-1]]).astype(np.int64)
    lo = np.searchsorted(found, starts, side="right")
    hi = np.searchsorted(found, starts + sizes, side="left")
    out = []
    for start, size, a, b in zip(starts.tolist(), sizes.tolist(), lo, hi, strict=True):
        if not size:
            out.append(np.empty(0, np.int64))
            continue
        ends = np.append(found[a:b] - start, size)
        wide = np.diff(ends, prepend=0)
        if wide.max() > LONGEST:
            own = slice(start, start + size)
            more = [
                _divided(int(end - width), int(end), value[own], possible[own])
                for end, width in zip(ends, wide, strict=True)
                if width > LONGEST
            ]
            ends = np.sort(np.concatenate([ends, *more]))
        out.append(ends)
    return out


def _divided(start: int, end: int, value: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Ends inside a long chunk: where its hash is smallest, and again in what is still long."""
    out, waiting = [], [(start, end)]
    while waiting:
        a, b = waiting.pop()
        if b - a <= LONGEST:
            continue
        places = np.flatnonzero(possible[a : b - 1])
        hashes = value[a : b - 1][places]
        cuts = [a]
        for at in (places[hashes == hashes.min()] + a + 1).tolist():
            if at - cuts[-1] >= APART or cuts[-1] == a:
                cuts.append(at)
        out += cuts[1:]
        waiting += zip(cuts, [*cuts[1:], b], strict=True)
    return np.array(out, np.int64)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in slices(batches, "text"):
        texts = text_bytes(batch.column("text"))
        ends = chunk_ends(texts)
        counts = np.array([len(found) for found in ends], np.int64)
        last = np.concatenate(ends)
        first = np.concatenate([[0], last[:-1]])
        first[(np.cumsum(counts) - counts)[counts > 0]] = 0
        owner = np.repeat(np.arange(len(texts)), counts)
        digests = [
            digest(texts[o][a:b])
            for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(owner)),
                pa.array(first, pa.int64()),
                pa.array(last, pa.int64()),
                pa.array(digests, pa.binary()),
            ],
            names=["doc_id", "start", "end", "digest"],
        )


def chunks(documents: DataFrame) -> DataFrame:
    """doc_id, start and end (bytes of the UTF-8 text) and digest of every chunk."""
    read = documents.select("doc_id", "text").where("doc_id is not null")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_chunks, f"doc_id {kind}, start bigint, end bigint, digest binary")


def repeats(documents: DataFrame) -> DataFrame:
    """The chunks whose digest occurs in several documents, with the smallest of them."""
    cut = chunks(documents)
    shared = settle(
        cut.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
        .where(F.col("first_doc_id") < F.col("last_doc_id")),
        "shared-chunks",
    )
    return cut.join(shared, "digest")


def _runs(found: DataFrame) -> DataFrame:
    """Neighbouring chunks of a document as one row, with the longest of them."""
    place = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before >= F.col("start"), 0).otherwise(1)
    # A row given twice has each chunk twice.
    again = F.coalesce(F.lag("start").over(place) == F.col("start"), F.lit(False))
    numbered = found.withColumns({"opens": opens, "again": again}).withColumn(
        "run", F.sum("opens").over(place)
    )
    later = (F.col("first_doc_id") < F.col("doc_id")) & ~F.col("again")
    size = (F.col("end") - F.col("start")).alias("size")
    chunk = F.struct(size, "start", "end", "digest", "first_doc_id", "last_doc_id")
    return (
        numbered.groupBy("doc_id", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum((~F.col("again")).cast("long")).alias("n_chunks"),
            F.min("first_doc_id").alias("first_doc_id"),
            F.sum(F.when(later, F.col("end") - F.col("start")).otherwise(0)).alias("repeated_bytes"),
            F.max(chunk).alias("longest"),
        )
        .drop("run")
    )


def _told(
    batches: Iterable[pa.RecordBatch],
    tell: Callable[[bytes, int, int], tuple],
    kinds: tuple[pa.DataType, ...],
) -> Iterator[pa.RecordBatch]:
    """What ``tell`` finds beside a document's own chunks, and beside those asked of it."""
    digest = xxhash.xxh3_128_digest
    for batch in slices(batches, "text"):
        rows = []
        seeds, asked = batch.column("seeds").to_pylist(), batch.column("asked").to_pylist()
        for at, text in enumerate(text_bytes(batch.column("text"))):
            for seed in seeds[at] or ():
                a, b = seed["start"], seed["end"]
                # Rows that share a doc_id may have other texts.
                if digest(text[a:b]) == seed["digest"]:
                    rows.append((at, a, None, *tell(text, a, b)))
            wanted = set(asked[at] or ())
            ends = chunk_ends([text])[0].tolist() if wanted else []
            for a, b in zip([0, *ends], ends, strict=False):
                if wanted and (own := digest(text[a:b])) in wanted:
                    wanted.remove(own)
                    rows.append((at, None, own, *tell(text, a, b)))
        columns = list(zip(*rows, strict=True)) or [()] * (3 + len(kinds))
        all_kinds = (pa.int64(), pa.binary(), *kinds)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                *(pa.array(values, kind) for values, kind in zip(columns[1:], all_kinds, strict=True)),
            ],
            names=["doc_id", "start", "digest", *(str(i) for i in range(len(kinds)))],
        )


# Bytes beside a chunk that its marks cover.
NEAR, FAR = 8, 32


def _marks(text: bytes, a: int, b: int) -> tuple[int, int | None, int, int | None]:
    """The nearest bytes at either side as a number, and a hash of more if there are as many.

    The nearest byte comes first in the number: to compare fewer, its lower bits are left out.
    """
    left, right = text[max(0, a - FAR) : a][::-1], text[b : b + FAR]
    return tuple(
        mark
        for side in (left, right)
        for mark in (
            int.from_bytes(side[:NEAR].ljust(NEAR, b"\0"), "big", signed=True),
            xxhash.xxh3_64_intdigest(side) - (1 << 63) if len(side) == FAR else None,
        )
    )


def _sides(text: bytes, a: int, b: int) -> tuple[bytes, bytes]:
    return text[max(0, a - LONGEST) : a], text[b : b + LONGEST]


_MARK_NAMES = ["near_before", "far_before", "near_after", "far_after"]
_SIDE_NAMES = ["before", "after"]


def _same(own: bytes, other: bytes) -> int:
    """Length of the common start."""
    n = min(len(own), len(other))
    unlike = np.frombuffer(own, np.uint8, n) != np.frombuffer(other, np.uint8, n)
    return int(unlike.argmax()) if unlike.any() else n


def _before(own: pa.Array, other: pa.Array) -> pa.Array:
    """Equal bytes that two places have before them, whole characters only."""
    out = []
    for x, y in zip(own.to_pylist(), other.to_pylist(), strict=True):
        n = _same(x[::-1], y[::-1]) if x and y else 0
        while n and x[-n] & 0xC0 == 0x80:
            n -= 1
        out.append(n)
    return pa.array(out, pa.int64())


def _after(own: pa.Array, other: pa.Array) -> pa.Array:
    """Equal bytes that two places have after them, whole characters only."""
    out = []
    for x, y in zip(own.to_pylist(), other.to_pylist(), strict=True):
        n = _same(x, y) if x and y else 0
        out.append(len(x[:n].decode("utf-8", "ignore").encode()) if n else 0)
    return pa.array(out, pa.int64())


def _others() -> dict[str, Column]:
    """The documents that a seed is held against: the first and the last with its chunk."""
    chunk = F.col("longest")
    return {
        name: F.when(chunk[f"{name}_doc_id"] != F.col("doc_id"), chunk[f"{name}_doc_id"])
        for name in ("first", "last")
    }


def _paired(
    documents: DataFrame, seeds: DataFrame, tell: Callable, names: list[str], kind: str
) -> DataFrame:
    """Seeds with what ``tell`` finds beside their chunk, in their document and the two others.

    Columns: ``names``, and the same after ``first_`` and ``last_``, NULL without such a document.
    """
    chunk = F.col("longest")
    asked = [
        seeds.select(other.alias("doc_id"), chunk["digest"].alias("asked")).where("doc_id is not null")
        for other in _others().values()
    ]
    # Both lists are bounded by the chunks of one document.
    wanted = (
        seeds.select("doc_id", F.struct("longest.start", "longest.end", "longest.digest").alias("seed"))
        .groupBy("doc_id")
        .agg(F.collect_list("seed").alias("seeds"))
        .join(
            asked[0]
            .unionByName(asked[1])
            .distinct()
            .groupBy("doc_id")
            .agg(F.collect_list("asked").alias("asked")),
            "doc_id",
            "full",
        )
    )
    read = documents.select("doc_id", "text").join(wanted, "doc_id")
    told_kinds = {"bigint": pa.int64(), "binary": pa.binary()}[kind]
    id_kind = read.schema["doc_id"].dataType.simpleString()
    told = settle(
        read.mapInArrow(
            partial(_told, tell=tell, kinds=(told_kinds,) * len(names)),
            f"doc_id {id_kind}, start bigint, digest binary, "
            + ", ".join(f"`{i}` {kind}" for i in range(len(names))),
        ).withColumnsRenamed({str(i): name for i, name in enumerate(names)}),
        "beside-seeds",
    )
    own = told.where("digest is null").select(
        F.col("doc_id").alias("own_doc"), F.col("start").alias("own_start"), *names
    )
    placed = seeds.join(
        own, (F.col("doc_id") == F.col("own_doc")) & (chunk["start"] == F.col("own_start"))
    )
    for name, other in _others().items():
        there = told.where("digest is not null").select(
            F.col("doc_id").alias(f"{name}_doc"),
            F.col("digest").alias(f"{name}_digest"),
            *[F.col(n).alias(f"{name}_{n}") for n in names],
        )
        same = (other == F.col(f"{name}_doc")) & (chunk["digest"] == F.col(f"{name}_digest"))
        placed = placed.join(there, same, "left")
    return placed


def _extensible(documents: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    """The seeds that may come to ``least`` bytes, by marks of the bytes beside their chunk.

    A run that lacks m bytes must gain half of them at one side at least, beyond its own
    end. So all bytes from the chunk to there are equal in the other document, and
    so are the marks of no more bytes than that. No seed that can be extended is lost; for the
    few left the bytes themselves are fetched and compared.
    """
    chunk = F.col("longest")
    half = F.ceil((F.lit(least) - (F.col("end") - F.col("start"))) / 2)
    needed = {
        "before": half + chunk["start"] - F.col("start"),
        "after": half + F.col("end") - chunk["end"],
    }

    def equal(other: str, side: str) -> Column:
        bits = (NEAR - F.least(needed[side], F.lit(NEAR))) * 8
        unlike = F.col(f"near_{side}").bitwiseXOR(F.col(f"{other}_near_{side}"))
        near = F.call_function("shiftrightunsigned", unlike, bits.cast("int")) == 0
        far = F.col(f"far_{side}") == F.col(f"{other}_far_{side}")
        return F.coalesce(near & ((needed[side] < FAR) | far), F.lit(False))

    may = [equal(other, side) for other in _others() for side in needed]
    marked = _paired(documents, seeds, _marks, _MARK_NAMES, "bigint")
    found = marked.where(may[0] | may[1] | may[2] | may[3])
    # Rows of one doc_id with equal texts tell the same twice.
    return settle(found.select(*seeds.columns).distinct(), "extensible-seeds")


def _passages(documents: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Runs from ``least`` bytes on, and shorter ones that come to it once extended."""
    runs = settle(_runs(found), "chunk-runs")
    names = ["doc_id", "start", "end", "n_chunks", "first_doc_id", "repeated_bytes"]
    long = F.col("end") - F.col("start") >= least
    chunk, others = F.col("longest"), _others()
    seeds = _extensible(documents, runs.where(~long), least)
    placed = _paired(documents, seeds, _sides, _SIDE_NAMES, "binary")
    # Bytes by which the matches with either document reach beyond the run.
    reach = {}
    for name in others:
        left = F.arrow_udf(_before, "bigint")("before", f"{name}_before")
        right = F.arrow_udf(_after, "bigint")("after", f"{name}_after")
        reach[f"{name}_left"] = F.greatest(F.lit(0), left + F.col("start") - chunk["start"])
        reach[f"{name}_right"] = F.greatest(F.lit(0), right + chunk["end"] - F.col("end"))
    first, last = (F.col(f"{name}_left") + F.col(f"{name}_right") for name in others)
    again = F.when(chunk["first_doc_id"] < F.col("doc_id"), first).otherwise(0)

    def longer(side: str) -> Column:
        return F.when(first >= last, F.col(f"first_{side}")).otherwise(F.col(f"last_{side}"))

    extended = (
        placed.withColumns(reach)
        .withColumns(
            {
                "start": F.col("start") - longer("left"),
                "end": F.col("end") + longer("right"),
                "repeated_bytes": F.col("repeated_bytes") + again,
            }
        )
        .where(long)
        # Two seeds in one passage extend to the same bytes.
        .groupBy("doc_id", "start", "end")
        .agg(
            F.max("n_chunks").alias("n_chunks"),
            F.min("first_doc_id").alias("first_doc_id"),
            F.max("repeated_bytes").alias("repeated_bytes"),
        )
    )
    return runs.where(long).select(*names).unionByName(extended.select(*names))


def passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per repeated passage of a document.

    doc_id, start, end (bytes), n_chunks, first_doc_id: the smallest doc_id that a
    chunk of it occurs in, repeated_bytes: how much of it occurs in a smaller doc_id,
    and kept: whether that is too little to be a passage, so this one came first.
    """
    found = _passages(documents, repeats(documents), least)
    return found.withColumn("kept", F.col("repeated_bytes") < least)


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cut in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
        if text is not None and cut:
            at, parts = 0, []
            for span in sorted(cut, key=lambda s: s["start"]):
                parts.append(text[at : span["start"]])
                at = max(at, span["end"])
            text = b"".join([*parts, text[at:]])
        out.append(None if text is None else text.decode())
    return pa.array(out, pa.string())


def drop_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without the passages that repeat smaller doc_ids' chunks."""
    # Held against the first document alone: a passage stays where it comes first.
    later = repeats(documents).where("first_doc_id < doc_id").withColumn("last_doc_id", F.col("doc_id"))
    spans = (
        _passages(documents, later, least)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )  # bounded by the passages of one document
    without = F.arrow_udf(_without, "string")
    # The row as one struct: no column of it has the name of a helper.
    rows = documents.select("doc_id", F.struct(*documents.columns).alias("row"))
    joined = rows.join(spans, "doc_id", "left")
    text = without(F.col("row.text"), F.col("spans")).alias("text")
    kept = [text if c == "text" else F.col("row")[c].alias(c) for c in documents.columns]
    return joined.select(*kept)
