"""Ids of whole texts by the tokenizers library, and the file they come from.

Byte-level pre-tokenisation never joins a character that is not white space with
white space after it. A text therefore falls into blocks, each the white space
before a run of other characters and that run, whose ids do not depend on each
other. Blocks repeat a lot: each worker has the library encode a block once and
keeps its ids in a bounded table, which drops the blocks looked up least when full. Texts with white space outside ASCII, with
control separators or with the special token's string go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

from shelflight.llm.common import ragged, run_sums

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0

# Entries of a worker's block table; beyond, it makes room or starts anew.
TABLE_ENTRIES = 500_000
# Blocks longer than this are encoded each time.
LONGEST_ENTRY = 48

_BLOCK = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_PAIRS = (b"  ", b" \n", b"\n ", b"\n\n")
# White space that only the library judges: control separators, next line,
# no-break space and the other Unicode spaces. Other texts lack the bytes that
# the longer ones begin with, so few are searched for them.
_RARE_BYTES = [bytes([b]) for b in (0x00, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F)]
_RARE_LEADS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"]
# Letters of the Latin blocks, and one full stop or comma.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)").fullmatch

# Line feed or start of text, if no space comes before it; letters; any ASCII marks after them.
_FORM = re.compile(
    "([\\x00\\n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)"
).fullmatch


def plain_block(name: bytes) -> tuple[str, str] | None:
    """The word and the stop of a block that is a space, Latin letters and perhaps a stop."""
    found = _PLAIN(name.decode())
    return found.groups() if found else None


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def special_strings(path: str) -> tuple[bytes, ...]:
    return tuple(
        token.content.encode() for token in library(path).get_added_tokens_decoder().values()
    )


class Blocks(dict):
    """Block -> its number; a new block gets the next one and waits to be filled in."""

    def __init__(self):
        super().__init__()
        self.waiting: list[bytes] = []

    def __missing__(self, block: bytes) -> int:
        number = self[block] = len(self)
        self.waiting.append(block)
        return number


def split_blocks(text: bytes, special: tuple[bytes, ...]) -> tuple[list[bytes], bool]:
    """The blocks of a text, or the text itself where it must stay whole.

    A block is named by its bytes after one space; any other starts with the
    line feed it begins with, or with a zero byte.
    """
    if any(part in text for part in (*_RARE_BYTES, *special)) or (
        not text.isascii() and any(part in text for part in _RARE_LEADS)
    ):
        return [text], True
    if b"\t" in text or b"\r" in text or any(pair in text for pair in _PAIRS):
        return [b"\x00" + block for block in _BLOCK.findall(text)], False
    if text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n"):
        return [b"\x00" + block for block in _BLOCK.findall(text)], False
    if not text:
        return [], False
    blocks = text.replace(b"\n", b" \n").split(b" ")
    blocks[0] = b"\x00" + blocks[0]
    return blocks, False


def block_bytes(name: bytes) -> bytes:
    if name[:1] == b"\x00":
        return name[1:]
    return name if name[:1] == b"\n" else b" " + name


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Encoder:
    """Ids of texts, block by block; one per worker and tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        self.special = special_strings(path)
        self.model = library(path).model
        self.characters = byte_characters()
        self.line_feed = self.model.token_to_id(self.characters[10])
        self._start_anew()

    def _start_anew(self) -> None:
        self.blocks = Blocks()
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 16, np.int64)
        self.lengths = np.empty(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.filled = 0
        self.marks: dict[str, list[int]] = {}

    def _make_room(self) -> None:
        """Keep the half of the entries that were looked up most often; older uses count less."""
        half = TABLE_ENTRIES // 2
        kept = np.sort(np.argpartition(-self.uses[: self.filled], half)[:half])
        names, lengths, uses = list(self.blocks), self.lengths[kept], self.uses[kept] // 2
        ids = self.ids[ragged(self.starts[kept], lengths)]
        self._start_anew()
        self.blocks.update((names[old], new) for new, old in enumerate(kept.tolist()))
        self._append(ids, lengths)
        self.uses[: self.filled] = uses

    def _append(self, ids: list[int] | np.ndarray, counts: list[int] | np.ndarray) -> None:
        """Enter the ids of the next blocks and how many each has."""
        flat, lengths = np.array(ids, np.uint32), np.array(counts, np.int64)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.filled + len(lengths) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        at = slice(self.filled, self.filled + len(lengths))
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.filled += len(lengths)

    def _fill_in(self, names: list[bytes]) -> None:
        """Encode the waiting blocks.

        A space and Latin letters are one piece before merging, as are letters alone
        after a line feed, which is a piece of its own, or where a text starts; the ASCII
        marks after them are another. Such a block needs no more than the library's merges.
        All others go through the library's whole chain.
        """
        tokenize, space, characters = self.model.tokenize, self.characters[32], self.characters
        forms = [_FORM(name.decode()) for name in names]
        others = [name for name, found in zip(names, forms, strict=True) if not found]
        whole = iter(self._library([block_bytes(name) for name in others]))
        ids: list[int] = []
        counts: list[int] = []
        for found in forms:
            if found:
                lead, word, marks = found.groups()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(characters)
                own = [token.id for token in tokenize(word if lead else space + word)]
                if lead == "\n":
                    own.insert(0, self.line_feed)
                if marks:
                    known = self.marks.get(marks)
                    if known is None:
                        known = self.marks[marks] = [token.id for token in tokenize(marks)]
                    own += known
            else:
                own = next(whole)
            ids += own
            counts.append(len(own))
        self._append(ids, counts)

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        found = library(self.path).encode_batch_fast(
            [text.decode() for text in texts], add_special_tokens=False
        )
        return [one.ids for one in found]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        if len(self.blocks) > TABLE_ENTRIES:
            self._make_room()
        number = self.blocks.__getitem__
        parts, counts, whole = [], [], {}
        for at, text in enumerate(texts):
            blocks, alone = split_blocks(text, self.special)
            if not blocks:
                counts.append(0)
                continue
            if alone:
                whole[at] = text
                counts.append(0)
                continue
            if len(max(blocks, key=len)) > LONGEST_ENTRY:
                # Long blocks would fill the table; such a text goes whole as well.
                whole[at] = text
                counts.append(0)
                continue
            counts.append(len(blocks))
            parts.append(np.fromiter(map(number, blocks), np.int64, len(blocks)))
        ids, totals = self._looked_up(parts, counts)
        own = self._library(list(whole.values())) if whole else []
        return self._merged(ids, totals, dict(zip(whole, own, strict=True)))

    def _looked_up(self, parts: list[np.ndarray], counts: list[int]):
        if self.blocks.waiting:
            self._fill_in(self.blocks.waiting)
            self.blocks.waiting = []
        chosen = np.concatenate(parts) if parts else np.empty(0, np.int64)
        np.add.at(self.uses, chosen, 1)
        lengths = self.lengths[chosen]
        ids = self.ids[ragged(self.starts[chosen], lengths)]
        return ids, run_sums(lengths, np.array(counts, np.int64))

    @staticmethod
    def _merged(ids, totals, found: dict[int, list[int]]):
        if not found:
            return ids, totals
        ends = np.cumsum(totals)
        parts, done = [], 0
        for at, own in found.items():
            parts += [ids[done : ends[at]], np.array(own, np.uint32)]
            done = ends[at]
        parts.append(ids[done:])
        totals = totals.copy()
        for at, own in found.items():
            totals[at] = len(own)
        return np.concatenate(parts), totals


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ids_with_end(texts: list[bytes], path: str, end: int = END_ID):
    """Ids of each text and the end id; and the number of ids of each."""
    ids, counts = encoder(path).encode(texts)
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end)), counts + 1


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of a contiguous array as binary values, without a copy per row."""
    data = np.ascontiguousarray(values)
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    offsets = pa.array(ends.astype(np.int64)).buffers()[1]
    return pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, offsets, pa.py_buffer(data)]
    ).cast(pa.binary())
