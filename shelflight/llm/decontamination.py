"""Benchmark decontamination: Wu-Manber search for windows of test items in whole texts.

Texts become their lower-cased words between single spaces, so a window of words is a
byte string that starts and ends at spaces, and each place where it stands is an
occurrence. Windows of similar length share tables: the shift table says how far a
block of bytes at the end of the search window allows to move on; where it says zero,
the hash of that block selects a bucket of windows, whose first bytes and then whole
strings are compared with the text. Many stretches of a text are searched in step.

The windows of all items are cut into blocks of bounded size by hash. A block travels
with the tasks; texts pass all blocks one after the other, the words hit so far with
them, so neither the driver nor a task holds more than a block.

Nulls: a null text has no words, is no item and is not hit; a null item_id counts as an
empty one. Rows of one item_id are one item. Equal windows of several items count for
each of them. Repeated documents are rows like others, null doc_ids too. A table
without rows, or without words, hits nothing. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import ragged, settle, slices, text_bytes

WINDOW = 10
# Bytes of windows and item ids in a block.
BLOCK_BYTES = 8 << 20
# Blocks that texts pass within one stage.
_CHAINED = 4
# Bytes of text that a lane searches.
_LANE = 1024
# Bytes that are hashed for the shift and the bucket, and bits of the hash.
_HASHED = 6
_HASH_BITS = 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Candidates compared at a time.
_COMPARED = 1 << 20

# Every byte outside 0-9, a-z and the non-ASCII ones separates words; A-Z are lowered.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_SPACES = re.compile(rb"  +")

_PAIRS = "window binary, item string"
_FOUND = "n_words bigint, n_hit bigint, spans array<bigint>, items array<string>"


def spaced_words(text: bytes) -> bytes:
    """The words between single spaces, one before and after; nothing if there are none."""
    words = _SPACES.sub(b" ", b" " + text.translate(_WORDS) + b" ")
    return words if len(words) > 1 else b""


# ---- search ---------------------------------------------------------------------


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``data`` ends on eight zeros."""
    shape = (*data.shape[:-1], data.shape[-1] - 7)
    return np.ndarray(shape, "<u8", buffer=data, strides=data.strides)


def _low_bytes(count: int) -> np.uint64:
    return np.uint64((1 << (8 * count)) - 1)


class Searcher:
    """Wu-Manber tables over patterns; ``numbers`` are what a match reports."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.width = min(map(len, patterns))
        self.block = min(_HASHED, self.width)
        self.mask = _low_bytes(self.block)
        padded = np.zeros((len(patterns), self.width + 8), np.uint8)
        joined = b"".join(p[: self.width] for p in patterns)
        padded[:, : self.width] = np.frombuffer(joined, np.uint8).reshape(-1, self.width)
        hashes = self._hash(_eights(padded)[:, : self.width - self.block + 1])
        farthest = self.width - self.block
        self.shift = np.full(1 << _HASH_BITS, farthest + 1, np.int64)
        for place in range(farthest + 1):
            # Later places allow less, and overwrite.
            self.shift[hashes[:, place]] = farthest - place
        order = np.argsort(hashes[:, -1], kind="stable")
        self.patterns = [patterns[i] for i in order]
        self.numbers = np.array(numbers, np.int64)[order]
        self.suffixes = hashes[order, -1]
        self.heads = _eights(padded)[order, 0]
        self.head_mask = _low_bytes(min(8, self.width))

    def _hash(self, eights: np.ndarray) -> np.ndarray:
        return (((eights & self.mask) * _FACTOR) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def _places(self, eights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Window starts that the shift table does not exclude, and their suffix hashes."""
        end = size - self.width + 1
        at = np.arange(0, max(end, 0), _LANE)
        stop = np.minimum(at + _LANE, end)
        found = [(at[:0], at[:0])]
        while at.size:
            hashed = self._hash(eights[at + (self.width - self.block)])
            step = self.shift[hashed]
            zero = step == 0
            if zero.any():
                found.append((at[zero], hashed[zero]))
                step[zero] = 1
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        places, hashes = zip(*found, strict=True)
        return np.concatenate(places), np.concatenate(hashes)

    def search(self, text: bytes, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of every occurrence of every pattern in ``text``."""
        places, hashes = self._places(eights, len(text))
        low = np.searchsorted(self.suffixes, hashes, "left")
        sizes = np.searchsorted(self.suffixes, hashes, "right") - low
        ends = np.cumsum(sizes)
        found = [(places[:0], places[:0])]
        done = 0
        while done < len(places):
            held = ends[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(ends, held + _COMPARED, "right")))
            at = np.repeat(places[done:to], sizes[done:to])
            which = ragged(low[done:to], sizes[done:to])
            alike = (eights[at] & self.head_mask) == self.heads[which]
            at, which = at[alike], which[alike]
            same = [
                text.startswith(self.patterns[w], a)
                for a, w in zip(at.tolist(), which.tolist(), strict=True)
            ]
            kept = np.array(same, bool)
            found.append((at[kept], self.numbers[which[kept]]))
            done = to
        found_places, numbers = zip(*found, strict=True)
        return np.concatenate(found_places), np.concatenate(numbers)


def searchers(patterns: list[bytes]) -> list[Searcher]:
    """Tables for patterns of each power of two of length: a short one shortens all shifts."""
    classes: dict[int, list[int]] = {}
    for number, pattern in enumerate(patterns):
        classes.setdefault(len(pattern).bit_length(), []).append(number)
    return [Searcher([patterns[n] for n in numbers], numbers) for numbers in classes.values()]


# ---- items ----------------------------------------------------------------------


def _cut(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        windows, items = [], []
        for item, text in zip(
            part.column("item").to_pylist(), text_bytes(part.column("text")), strict=True
        ):
            spaced = spaced_words(text)
            if not spaced:
                continue
            ends = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
            last = max(len(ends) - 1 - words, 0)
            for at in range(last + 1):
                windows.append(spaced[ends[at] : ends[min(at + words, len(ends) - 1)] + 1])
                items.append(item)
        columns = [pa.array(windows, pa.binary()), pa.array(items, pa.string())]
        yield pa.record_batch(columns, ["window", "item"])


def item_windows(benchmark: DataFrame, words: int = WINDOW) -> DataFrame:
    """(window, item): the windows of ``words`` successive words; a shorter item is one."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    cut = benchmark.select(item, "text").mapInArrow(partial(_cut, words=words), _PAIRS)
    return cut.distinct()


# ---- documents ------------------------------------------------------------------


class Block:
    """A block's windows, each with the places of its items in the list of items."""

    def __init__(self, pairs: pa.Table):
        windows = pairs.column("window").to_pylist()
        items = pairs.column("item").to_pylist()
        self.items = sorted(set(items))
        number = {item: i for i, item in enumerate(self.items)}
        of_window: dict[bytes, list[int]] = {}
        for window, item in zip(windows, items, strict=True):
            of_window.setdefault(window, []).append(number[item])
        self.windows = list(of_window)
        self.sizes = np.array([len(v) for v in of_window.values()], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of_window = np.array([i for v in of_window.values() for i in v], np.int64)
        self.lengths = np.array([w.count(b" ") - 1 for w in self.windows], np.int64)


def _hits(part: pa.RecordBatch, block: Block, tables: list[Searcher]) -> list[pa.Array]:
    """n_words, n_hit, spans and items of the texts, with what earlier blocks found."""
    texts = [spaced_words(text) for text in text_bytes(part.column("text"))]
    joined = b"\n".join(texts)
    data = np.frombuffer(joined + bytes(8), np.uint8)
    eights = _eights(data)
    spaces = np.flatnonzero(data[: len(joined)] == 32)
    # A text of n words has n + 1 spaces; the word after each space has its number.
    held = np.array([text.count(b" ") for text in texts], np.int64)
    base = np.cumsum(held) - held
    change = np.zeros(len(spaces) + 1, np.int64)
    owners, items = [base[:0]], [base[:0]]
    for table in tables:
        places, numbers = table.search(joined, eights)
        first = np.searchsorted(spaces, places)
        np.add.at(change, first, 1)
        np.add.at(change, first + block.lengths[numbers], -1)
        owner = np.searchsorted(base, first, "right") - 1
        owners.append(np.repeat(owner, block.sizes[numbers]))
        items.append(block.of_window[ragged(block.starts[numbers], block.sizes[numbers])])
    pairs = np.unique(np.concatenate(owners) * len(block.items) + np.concatenate(items))
    named: dict[int, set[str]] = {}
    for pair in pairs.tolist():
        named.setdefault(pair // len(block.items), set()).add(block.items[pair % len(block.items)])
    if "spans" in part.schema.names:
        for at, (spans, before) in enumerate(
            zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)
        ):
            if spans:
                edges = np.array(spans, np.int64).reshape(-1, 2) + base[at]
                np.add.at(change, edges[:, 0], 1)
                np.add.at(change, edges[:, 1], -1)
                named.setdefault(at, set()).update(before)
    hit = np.concatenate([[False], np.cumsum(change) > 0])
    edges = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    owner = np.searchsorted(base, edges[:, 0], "right") - 1
    n_hit = np.bincount(owner, edges[:, 1] - edges[:, 0], len(texts)).astype(np.int64)
    spans: list[list[int]] = [[] for _ in texts]
    for at, edge in zip(owner.tolist(), (edges - base[owner][:, None]).tolist(), strict=True):
        spans[at] += edge
    return [
        pa.array(np.maximum(held - 1, 0)),
        pa.array(n_hit),
        pa.array(spans, pa.list_(pa.int64())),
        pa.array([sorted(named.get(at, ())) for at in range(len(texts))], pa.list_(pa.string())),
    ]


def _scan(
    batches: Iterable[pa.RecordBatch], block: Block, carried: list[str]
) -> Iterator[pa.RecordBatch]:
    tables = searchers(block.windows)
    names = [*carried, "n_words", "n_hit", "spans", "items"]
    for part in slices(batches, "text"):
        kept = [part.column(name) for name in carried]
        yield pa.RecordBatch.from_arrays([*kept, *_hits(part, block, tables)], names)


def _block(pairs: DataFrame, blocks: int, number: int) -> Block:
    mine = F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == number
    return Block(pairs.where(mine).toArrow())


def _searched(rows: DataFrame, benchmark: DataFrame, words: int) -> DataFrame:
    """``rows`` (row, text) with n_words, n_hit, spans and items, without the text."""
    pairs = settle(item_windows(benchmark, words), "windows")
    size = F.sum(F.octet_length("window") + F.octet_length("item") + 16)
    blocks = max(1, -(-(pairs.agg(size.alias("size")).first().size or 0) // BLOCK_BYTES))
    kind = rows.schema["row"].dataType.simpleString()
    for number in range(blocks):
        last = number == blocks - 1
        carried = ["row"] if last else ["row", "text"]
        schema = f"row {kind}, {'' if last else 'text string, '}{_FOUND}"
        scan = partial(_scan, block=_block(pairs, blocks, number), carried=carried)
        rows = rows.mapInArrow(scan, schema)
        if not last and number % _CHAINED == _CHAINED - 1:
            rows = settle(rows, "searched")
    return rows


def contaminated_spans(
    documents: DataFrame, benchmark: DataFrame, words: int = WINDOW
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans and items.

    ``spans``: first word and word after the last one of each stretch of hit words, in
    turn. ``items``: the items of which a window occurs, as sorted texts.
    """
    rows = documents.select(F.struct("doc_id").alias("row"), "text")
    return _searched(rows, benchmark, words).select("row.doc_id", "n_words", "n_hit", "spans", "items")


def contamination(documents: DataFrame, benchmark: DataFrame, words: int = WINDOW) -> DataFrame:
    """Per document: counts of words, hit words and items, the items' digest, the verdict."""
    listed = F.array_join(F.array_sort("items"), ",")
    return contaminated_spans(documents, benchmark, words).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, words: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    rows = documents.select(F.struct(*documents.columns).alias("row"), "text")
    return _searched(rows, benchmark, words).where("n_hit = 0").select("row.*")
