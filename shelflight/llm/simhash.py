"""Near duplicates by SimHash: fingerprints within a few bits of each other, linked.

A text's words, A-Z lower-cased, give shingles; a fingerprint bit is set if it is
set in more than half of their XXH64 values. Fingerprints are linked by a binary
trie joined with itself: pairs of nodes go down together, differing bits add up,
and a pair is pruned when they exceed the budget.

Of budget + 1 groups of bits, two linked fingerprints agree on one at least. Each
group's bits form the upper levels of one trie, where only equal branches can
link; those levels are walked by the shuffle, which brings the fingerprints of a
branch to one task, and the task walks the levels below. A branch that holds too
many is cut again the same way by the bits that still vary in it, until it is a
small task; no fingerprint is dropped. Equal fingerprints are walked once. A task hands
over a spanning forest of its links, never all pairs of a dense group.

Nulls: a null text counts as empty; texts without words have fingerprint zero and
link like any other; texts with fewer words than a shingle are one shingle. A row
given twice comes out twice. Null doc_ids never name a component unless no other
id is in it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import lowered, only_rows, settle, slices, text_bytes, text_key
from shelflight.llm.components import components, merge_pairs

SHINGLE = 3
BUDGET = 3
HASH_SEED = 42
BITS = 64
# Fingerprints of one branch that a task walks by itself.
BRANCH_ROWS = 20_000
# Node pairs with at most this many fingerprint pairs are compared directly.
LEAF_PAIRS = 64
# Node pairs, and fingerprint pairs, held at a time.
FRONTIER = 1 << 18

_xxh64 = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)


# ---- fingerprints ----------------------------------------------------------------


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = lowered(text).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [_xxh64(joined)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first = (ends - lengths)[: len(words) - size + 1].tolist()
    return [_xxh64(joined[a:b]) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), FRONTIER):
        part = hashes[at : at + FRONTIER].view(np.uint8).reshape(-1, BITS // 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    bits = majority(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [fingerprint(text, size) for text in text_bytes(batch.column("text"))]
        column = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), column],
            names=["doc_id", "text_key", "fp"],
        )


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key and fp, the fingerprint's 64 bits as a signed number."""
    read = documents.select("doc_id", text_key().alias("text_key"), "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(
        partial(_fingerprints, size=size), f"doc_id {kind}, text_key bigint, fp bigint"
    )


# ---- the trie --------------------------------------------------------------------


def linked_pairs(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits inside each of the runs.

    Each run is a sorted trie: a node is a range of it whose values share their
    upper bits. A chunk of node pairs goes down one level at a time; chunks that grow
    are halved and wait on a stack, so memory is bounded.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int64))]
    while stack:
        level, a0, a1, b0, b1, apart = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            for cut in (slice(None, half), slice(half, None)):
                stack.append((level, *(x[cut] for x in (a0, a1, b0, b1, apart))))
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (level == BITS)
        yield from _compared(values, *(x[small] for x in (a0, a1, b0, b1)), budget)
        large = ~small
        a0, a1, b0, b1, apart = (x[large] for x in (a0, a1, b0, b1, apart))
        if not len(a0):
            continue
        if level not in ones:
            bit = (values >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        count = ones[level]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        other = a0 != b0  # of a node with itself, the two mixed branches are one
        below = (
            np.concatenate([a0, am, a0, am[other]]),
            np.concatenate([am, a1, am, a1[other]]),
            np.concatenate([b0, bm, bm, b0[other]]),
            np.concatenate([bm, b1, b1, bm[other]]),
            np.concatenate([apart, apart, apart + 1, apart[other] + 1]),
        )
        alive = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)
        stack.append((level + 1, *(x[alive] for x in below)))


def _compared(values, a0, a1, b0, b1, budget: int):
    """The linked pairs of small node pairs, each value compared with each."""
    sizes = (a1 - a0) * (b1 - b0)
    keep = sizes > 0
    a0, b0, b1, sizes = a0[keep], b0[keep], b1[keep], sizes[keep]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * FRONTIER)))
        part = slice(at, to)
        node = np.repeat(np.arange(at, to), sizes[part])
        within = np.arange(len(node)) - np.repeat(ends[part] - sizes[part], sizes[part])
        within += (ends[at] - sizes[at])
        width = (b1 - b0)[node]
        i, j = a0[node] + within // width, b0[node] + within % width
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        yield i[near], j[near]
        at = to


def _forest(values: np.ndarray, branch: np.ndarray, budget: int) -> pa.RecordBatch | None:
    """Links of one task's branches as edges to the smallest value of each set."""
    edge = np.flatnonzero(np.concatenate([[True], branch[1:] != branch[:-1]]))
    starts, ends = edge, np.append(edge[1:], len(values))
    several = ends - starts > 1
    labels = np.arange(len(values))
    for i, j in linked_pairs(values, starts[several], ends[several], budget):
        labels = merge_pairs(labels, i, j)
    member = np.flatnonzero(labels != np.arange(len(values)))
    signed = values.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed[member]), pa.array(signed[labels[member]])], names=["u", "v"]
    )


def _walk(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Whole branches at a time, of rows sorted by branch and unsigned value."""
    masks, heads, values = [], [], []

    def gathered():
        return (np.concatenate(x) for x in (masks, heads, values))

    def numbered(mask, head):
        new = (mask[1:] != mask[:-1]) | (head[1:] != head[:-1])
        return np.concatenate([[0], np.cumsum(new)])

    for batch in batches:
        masks.append(batch.column("mask").to_numpy())
        heads.append(batch.column("head").to_numpy())
        values.append(batch.column("fp").to_numpy().view(np.uint64) ^ np.uint64(1 << (BITS - 1)))
        if sum(map(len, values)) < FRONTIER:
            continue
        mask, head, value = gathered()
        branch = numbered(mask, head)
        whole = int(np.searchsorted(branch, branch[-1]))  # the last may go on
        masks, heads, values = [mask[whole:]], [head[whole:]], [value[whole:]]
        if whole:
            yield _signed(_forest(value[:whole], branch[:whole], budget))
    if values:
        mask, head, value = gathered()
        if len(value):
            yield _signed(_forest(value, numbered(mask, head), budget))


def _signed(edges: pa.RecordBatch) -> pa.RecordBatch:
    """Back from values whose order is that of signed numbers."""
    top = np.uint64(1 << (BITS - 1))
    back = [(c.to_numpy().view(np.uint64) ^ top).view(np.int64) for c in edges.columns]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in back], names=edges.schema.names)


def _signed_mask(bits: Iterable[int]) -> int:
    mask = sum(1 << int(b) for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cuts(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each crowded branch: its mask with each of ``parts`` groups of the bits that vary."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            free = [b for b in range(BITS) if row["varying"] >> b & 1]
            for group in np.array_split(free, parts):
                if len(group):
                    rows.append((row["mask"], row["head"], row["mask"] | _signed_mask(group)))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["mask", "head", "cut"]
        )


def links(prints: DataFrame, budget: int = BUDGET, branch_rows: int = BRANCH_ROWS) -> DataFrame:
    """Edges (u, v) that connect all of the distinct ``prints`` (fp) within ``budget`` bits."""
    masks = [_signed_mask(bits) for bits in np.array_split(range(BITS), budget + 1)]
    head = F.col("fp").bitwiseAND(F.col("mask"))
    first = F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")
    branches = prints.select("fp", first).withColumn("head", head)
    walked = []
    while True:
        counted = branches.groupBy("mask", "head").agg(
            F.count("*").alias("rows"), F.expr("bit_or(fp) & ~bit_and(fp)").alias("varying")
        )
        crowded = counted.where(F.col("rows") > branch_rows).drop("rows")
        cuts = settle(
            crowded.mapInArrow(partial(_cuts, parts=budget + 1), "mask bigint, head bigint, cut bigint"),
            "crowded-branches",
        )
        if cuts.isEmpty():
            walked.append(branches)
            break
        branch = ["mask", "head"]
        walked.append(branches.join(cuts.select(*branch).distinct(), branch, "left_anti"))
        below = branches.join(cuts, branch).select("fp", F.col("cut").alias("mask"))
        branches = settle(below.withColumn("head", head), "cut-branches")
    rows = walked[0]
    for more in walked[1:]:
        rows = rows.unionByName(more)
    placed = rows.repartition("mask", "head").sortWithinPartitions("mask", "head", "fp")
    return placed.mapInArrow(partial(_walk, budget=budget), "u bigint, v bigint")


# ---- documents -------------------------------------------------------------------


def _grouped(prints: DataFrame, budget: int) -> DataFrame:
    """fp and the component of each distinct fingerprint."""
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "fingerprints")
    reached = components(links(distinct.select("fp"), budget))
    rooted = distinct.join(reached, distinct.fp == reached.node, "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return settle(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-groups")


def near_groups(documents: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (and text_key)."""
    prints = settle(fingerprints(documents, size), "document-fingerprints")
    return prints.join(_grouped(prints, budget), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        "component_id",
        "text_key",
    )


def drop_near_copies(documents: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The documents, one of each component: that with the smallest doc_id."""
    groups = near_groups(documents, size, budget)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    lone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    first = groups.groupBy("component_id", lone.alias("lone")).agg(F.min(row).alias("row"))
    return only_rows(documents, first.select("row.doc_id", "row.text_key"))
