"""Token counts without ids: byte-pair merging on a heap and a linked list.

A piece of text starts as one symbol per byte. The adjacent pairs that can merge
wait in a heap by rank and place; the lowest is popped and merged, its neighbours
are relinked and their new pairs pushed, until no pair is left. The count is the
initial symbols less the merges; no ids are made.

Merging never crosses the pieces that the tokenizer's pattern cuts a text into,
so a worker keeps the counts of pieces it has seen, in a bounded table. A special
token's string in a text is one token, as the library has it by default.

Nulls: a null text counts as empty, with no bytes and no tokens. Null and repeated
doc_ids are rows like others. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import run_sums, slices, text_bytes
from shelflight.llm.tokens import (
    LONGEST_ENTRY,
    TABLE_ENTRIES,
    Blocks,
    block_bytes,
    byte_characters,
    plain_block,
    split_blocks,
    tokenizer_path,
)

LIMIT = 512
# Place of a pair in its piece, in the lower bits of a heap entry.
_PLACE_BITS = 40
_PLACE = (1 << _PLACE_BITS) - 1


class Merges:
    """The ranked merges of a byte-level vocabulary file, over numbered symbols."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        vocabulary = given["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
        self.base = len(vocabulary)
        self.first = [vocabulary[character] for _, character in sorted(byte_characters().items())]
        self.rank = {
            vocabulary[a] * self.base + vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)
        }
        self.merged = [vocabulary[a + b] for a, b in pairs]
        self.special = tuple(t["content"].encode() for t in given["added_tokens"])
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        if self.special:
            names = sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True)
            self.specials = regex.compile("|".join(map(regex.escape, names)))

    def count(self, piece: bytes) -> int:
        """Symbols left of one piece."""
        symbols = [self.first[b] for b in piece]
        n = len(symbols)
        base, rank, merged = self.base, self.rank.get, self.merged
        heap = []
        for at in range(n - 1):
            found = rank(symbols[at] * base + symbols[at + 1])
            if found is not None:
                heap.append(found << _PLACE_BITS | at)
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            lowest = heapq.heappop(heap)
            at, best = lowest & _PLACE, lowest >> _PLACE_BITS
            follower = after[at]
            # A pair that has changed since it was pushed is passed over.
            if follower >= n or symbols[at] < 0:
                continue
            if rank(symbols[at] * base + symbols[follower]) != best:
                continue
            symbols[at] = symbol = merged[best]
            symbols[follower] = -1
            after[at] = beyond = after[follower]
            left -= 1
            if beyond < n:
                before[beyond] = at
                found = rank(symbol * base + symbols[beyond])
                if found is not None:
                    heapq.heappush(heap, found << _PLACE_BITS | at)
            previous = before[at]
            if previous >= 0:
                found = rank(symbols[previous] * base + symbol)
                if found is not None:
                    heapq.heappush(heap, found << _PLACE_BITS | previous)
        return left


class Counter:
    """Token counts of texts, block by block; one per worker and vocabulary file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self._start_anew()

    def _start_anew(self) -> None:
        self.blocks = Blocks()
        self.counts = np.empty(1 << 16, np.int64)
        self.pieces: dict[bytes, int] = {}

    def _piece(self, piece: bytes) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merges.count(piece)
            if len(piece) <= LONGEST_ENTRY:
                self.pieces[piece] = found
        return found

    def _text(self, text: str) -> int:
        """Tokens of a text or block without special tokens."""
        return sum(self._piece(piece.encode()) for piece in self.merges.pattern.findall(text))

    def _whole(self, text: bytes) -> int:
        if not any(token in text for token in self.merges.special):
            return self._text(text.decode())
        parts = self.merges.specials.split(text.decode())
        return len(parts) - 1 + sum(map(self._text, parts))

    def _block(self, name: bytes) -> int:
        plain = plain_block(name)
        if plain:
            word, stop = plain
            return self._piece(b" " + word.encode()) + len(stop)
        return self._text(block_bytes(name).decode())

    def count(self, texts: list[bytes]) -> np.ndarray:
        if len(self.blocks) > TABLE_ENTRIES or len(self.pieces) > TABLE_ENTRIES:
            self._start_anew()
        number = self.blocks.__getitem__
        parts, sizes, whole = [], [], {}
        for at, text in enumerate(texts):
            blocks, alone = split_blocks(text, self.merges.special)
            if alone or (blocks and len(max(blocks, key=len)) > LONGEST_ENTRY):
                whole[at] = self._whole(text)
                sizes.append(0)
                continue
            sizes.append(len(blocks))
            parts.append(np.fromiter(map(number, blocks), np.int64, len(blocks)))
        new = self.blocks.waiting
        if new:
            known = len(self.blocks) - len(new)
            while len(self.counts) < len(self.blocks):
                self.counts = np.concatenate([self.counts, np.empty_like(self.counts)])
            self.counts[known : len(self.blocks)] = [self._block(name) for name in new]
            self.blocks.waiting = []
        chosen = np.concatenate(parts) if parts else np.empty(0, np.int64)
        totals = run_sums(self.counts[chosen], np.array(sizes, np.int64))
        for at, found in whole.items():
            totals[at] = found
        return totals


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def _count(
    batches: Iterable[pa.RecordBatch], path: str, limit: int
) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = text_bytes(batch.column("text"))
        found = counter(path).count(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array(found, pa.int64()),
                pa.array(found > limit),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    read = documents.select("doc_id", F.col("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(
        partial(_count, path=path or tokenizer_path(), limit=limit),
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
