"""Quality rules by distribution divergence.

Every language gets a reference from all of its documents that pass the base rules:
how often each class of characters occurs, and how often each of its common words
does, all other words together being one more entry. A document is held against the reference of its
language by the Jensen-Shannon distance (0 to 1) of either histogram and rejected
where one exceeds its limit. Short documents have ragged histograms by chance:
below a minimum length a histogram is not judged. Labels may be wrong, so a
document goes only if the references of all other languages reject it as well.

A language has a reference if it has ``least`` words, however large the corpus. A
common word makes up ``common`` of its language's words, which bounds a reference
to 1/common words. The references travel with the tasks in blocks of ``LANGS``
languages; where there are more, texts pass all blocks, first for their own language,
then, if it rejects them, for the others. A verdict depends on the languages' own
texts only, not on their share of the corpus. A document of a language without a
reference is not judged by distance: other languages say nothing about it. A word
histogram of n words diverges by about entries / (8 n ln 2) bits by chance alone, which
is taken off before its limit applies.

Besides, two base rules reject a document: fewer than 20 words, or more than 30 %
of its words in 8-word windows that repeat in it.

Nulls: a null text has no words; a null language is held against the references of
all languages. Where nothing has a reference, the base rules decide.
Empty texts fail the base rules. Rows are judged one by one, so repeated rows get
the same verdict; an empty table gives an empty result. Other columns are ignored,
and kept by ``drop_rejected``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import run_sums, settle, slices, text_bytes

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
COMMON = 0.004
# Words from which a language has a reference.
LEAST = 5_000
# Languages whose references travel with a task at a time.
LANGS = 2_000
# Limits of the distances, and the lengths from which they are judged.
CLASS_LIMIT = 0.3
CLASS_MIN_CHARS = 300
WORD_LIMIT = 0.27
WORD_MIN_WORDS = 60
# Distinct words that a task counts before it hands them over.
COUNTED_WORDS = 300_000

SYMBOLS = b"#*$%&|<>"
_CLASSES = ["lower", "upper", "digit", "stop", "symbol", "other", "blank", "lead2", "lead3", "lead4"]
_CONTINUED = len(_CLASSES)


def _class_of(byte: int) -> int:
    if byte >= 0x80:
        lead = "lead2" if byte < 0xE0 else "lead3" if byte < 0xF0 else "lead4"
        return _CONTINUED if byte < 0xC0 else _CLASSES.index(lead)
    char = chr(byte)
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        name = "blank"
    elif byte in SYMBOLS:
        name = "symbol"
    elif char.isalpha():
        name = "lower" if char.islower() else "upper"
    elif char.isdigit():
        name = "digit"
    else:
        name = "stop" if char in ".,;:!?'\"()-" else "other"
    return _CLASSES.index(name)


_CLASS = np.array([_class_of(b) for b in range(256)])
# Byte histograms times this are class histograms.
_INTO_CLASSES = np.eye(_CONTINUED + 1, dtype=np.int64)[_CLASS]
# Words of the word histograms: ASCII letters lower-cased, other ASCII signs as blanks.
_LETTERS = bytes(
    ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() else b if b >= 0x80 else 0x20
    for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _byte_counts(texts: list[bytes]) -> np.ndarray:
    return np.stack(
        [np.bincount(np.frombuffer(text, np.uint8), minlength=256) for text in texts]
    ).reshape(-1, 256)


def base_rules(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, of words in repeated windows, and whether a base rule rejects."""
    split = [text.split() for text in texts]
    n_words = np.array([len(words) for words in split], np.int64)
    repeats = repeated_words(split)
    return n_words, repeats, (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)


# ---- references ------------------------------------------------------------------


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of all words, and (lang, null, class counts)."""
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}

    def given() -> pa.RecordBatch:
        langs, names, counts = [], [], []
        for lang, counter in words.items():
            langs += [lang] * len(counter)
            names += counter.keys()
            counts += [[n] for n in counter.values()]
        for lang, found in classes.items():
            langs.append(lang)
            names.append(None)
            counts.append(found.tolist())
        words.clear()
        classes.clear()
        columns = [pa.array(langs, pa.string()), pa.array(names, pa.binary())]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(counts, pa.list_(pa.int64()))], names=["lang", "word", "n"]
        )

    for batch in slices(batches, "text"):
        texts = text_bytes(batch.column("text"))
        found = _byte_counts(texts) @ _INTO_CLASSES
        failed = base_rules(texts)[2].tolist()
        langs = batch.column("lang").to_pylist()
        for lang, text, own, bad in zip(langs, texts, found, failed, strict=True):
            if bad:
                continue
            words.setdefault(lang, Counter()).update(plain_words(text))
            classes[lang] = classes.get(lang, 0) + own
        if sum(map(len, words.values())) > COUNTED_WORDS:
            yield given()
    yield given()


class References:
    """Class and common-word shares of each language."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, dict[bytes, float]]):
        self.langs = sorted(classes)
        self.classes = {lang: classes[lang] for lang in self.langs}
        self.words = {lang: list(words.get(lang, {})) for lang in self.langs}
        self.shares = {
            lang: np.array([*words.get(lang, {}).values(), 0.0]) for lang in self.langs
        }
        for shares in self.shares.values():
            shares[-1] = max(0.0, 1.0 - shares.sum())


def references(documents: DataFrame, common: float = COMMON, least: int = LEAST) -> DataFrame:
    """(lang, classes, words) from the documents that pass the base rules, one row per
    language of enough words; a null language adds to none."""
    partial_counts = documents.select("lang", "text").where("lang is not null").mapInArrow(
        _counts, "lang string, word binary, n array<bigint>"
    )
    width = _CONTINUED + 1
    sums = [F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(width)]
    counted = partial_counts.groupBy("lang", "word").agg(*sums)
    kept = settle(counted, "word-counts")
    # Settled, so that the words meet their languages' totals, of known size, where they are.
    totals = settle(
        kept.where("word is not null").groupBy("lang").agg(F.sum("n0").alias("words")), "word-totals"
    )
    common_word = F.col("word").isNull() | (F.col("n0") >= F.col("words") * common)
    counts = F.array(*[f"n{i}" for i in range(_CONTINUED)])
    word = F.struct("word", (F.col("n0") / F.col("words")).alias("share"))
    found = (
        kept.join(totals.where(F.col("words") >= least), "lang")
        .where(common_word)
        .groupBy("lang")
        .agg(
            F.first(F.when(F.col("word").isNull(), counts), ignorenulls=True).alias("classes"),
            F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), word))).alias("words"),
        )
    )
    return settle(found, "references")


def _block(table: DataFrame, blocks: int, number: int) -> References:
    """A block's references: at most 1/common words for each of about LANGS languages."""
    mine = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == number
    rows = table.where(mine).collect() if blocks > 1 else table.collect()
    return References(
        {row.lang: _shares(row.classes) for row in rows},
        {row.lang: {bytes(w.word): w.share for w in row.words} for row in rows},
    )


def _shares(counts: list[int]) -> np.ndarray:
    found = np.array(counts, float)
    return found / max(1.0, found.sum())


# ---- verdicts --------------------------------------------------------------------


def js_distance(counts: np.ndarray, reference: np.ndarray, chance: bool = False) -> np.ndarray:
    """Distance of each row of counts from the reference, 0 (equal) to 1 (disjoint).

    ``chance`` takes off the divergence that a sample of the row's size has by chance.
    """
    own = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    middle = (own + reference) / 2

    def divergence(p, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(p > 0, p * np.log2(p / q), 0.0).sum(axis=1)

    both = (divergence(own, middle) + divergence(np.broadcast_to(reference, own.shape), middle)) / 2
    if chance:
        both = both - (len(reference) - 1) / (8 * np.log(2) * np.maximum(1, counts.sum(axis=1)))
    return np.sqrt(np.clip(both, 0.0, 1.0))


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found more than once in it."""
    lengths = np.array([len(words) for words in texts], np.int64)
    hashes = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(lengths.sum()))
    total = len(hashes)
    if total < window:
        return np.zeros(len(texts), np.int64)
    # 64-bit sums of the words' hashes under odd factors stand for the windows.
    mixed = np.zeros(total - window + 1, np.uint64)
    factor = np.uint64(1)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)].view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: len(mixed)] == owner[window - 1 :]
    starts = np.flatnonzero(inside)
    keys = mixed[starts] ^ (owner[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    twice = starts[pd.Series(keys).duplicated(keep=False).to_numpy()]
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + window, -1)
    return run_sums(np.cumsum(steps[:-1]) > 0, lengths)


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


_FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "class_distance": pa.float64(),
    "word_distance": pa.float64(),
}
# Also kept while texts pass the blocks: whether the language has a reference.
_STATE = {**_FIELDS, "judged": pa.bool_()}


def _judge(
    texts: list[bytes], langs: list, known: References, own: bool, others: bool, before: dict
) -> dict[str, np.ndarray]:
    """Counts and verdicts, by the texts' own languages, by all others, or both.

    ``before`` holds the distances and who was judged in earlier blocks.
    """
    histograms = _byte_counts(texts)
    classes = (histograms @ _INTO_CLASSES)[:, :_CONTINUED]
    n_words, repeats, failed = base_rules(texts)
    chars = classes.sum(axis=1)
    words = [plain_words(text) for text in texts]
    plain = np.array([len(found) for found in words], np.int64)
    by_class = before.get("class_distance", np.full(len(texts), np.inf))
    by_word = before.get("word_distance", np.full(len(texts), np.inf))
    judged = before.get("judged", np.zeros(len(texts), bool))

    def measure(rows: np.ndarray, lang: str) -> None:
        """Keep the distances from the reference that fits best."""
        place = {word: at for at, word in enumerate(known.words[lang])}
        other = len(place)
        counts = np.stack(
            [
                np.bincount([place.get(word, other) for word in words[at]], minlength=other + 1)
                for at in rows
            ]
        )
        c = js_distance(classes[rows], known.classes[lang])
        w = js_distance(counts, known.shares[lang], chance=True)
        better = np.maximum(c / CLASS_LIMIT, w / WORD_LIMIT) < np.maximum(
            by_class[rows] / CLASS_LIMIT, by_word[rows] / WORD_LIMIT
        )
        by_class[rows[better]], by_word[rows[better]] = c[better], w[better]

    def rejected() -> np.ndarray:
        return ((chars >= CLASS_MIN_CHARS) & (by_class > CLASS_LIMIT)) | (
            (plain >= WORD_MIN_WORDS) & (by_word > WORD_LIMIT)
        )

    if own:
        rows_of: dict[str | None, list[int]] = {}
        for at, lang in enumerate(langs):
            rows_of.setdefault(lang, []).append(at)
        # A null language may be any; one without a reference is not judged.
        for lang, rows in rows_of.items():
            if lang in known.classes:
                measure(np.array(rows), lang)
            judged[rows] |= lang in known.classes or (lang is None and bool(known.langs))
    if others:
        mine = np.array(langs, object)
        for lang in known.langs:
            if len(rows := np.flatnonzero(judged & rejected() & (mine != lang))):
                measure(rows, lang)
    return {
        "n_words": n_words,
        "word_chars": chars - classes[:, _CLASSES.index("blank")],
        "n_symbols": histograms[:, list(SYMBOLS)].sum(axis=1),
        "n_dup_lines": np.array([_duplicate_lines(text) for text in texts], np.int64),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & ~(judged & rejected()),
        "class_distance": by_class,
        "word_distance": by_word,
        "judged": judged,
    }


def _arrays(state: dict[str, np.ndarray]) -> pa.StructArray:
    """The state as a column; a distance of -1 where nothing was compared."""
    shown = {k: np.where(np.isinf(v), -1.0, v) if v.dtype == float else v for k, v in state.items()}
    columns = [pa.array(shown[name], kind) for name, kind in _STATE.items()]
    return pa.StructArray.from_arrays(columns, names=list(_STATE))


def _first(part: pa.RecordBatch, known: References, others: bool) -> pa.StructArray:
    texts, langs = text_bytes(part.column("text")), part.column("lang").to_pylist()
    return _arrays(_judge(texts, langs, known, True, others, {}))


def _further(part: pa.RecordBatch, known: References, own: bool) -> pa.StructArray:
    """The state after another block; only texts that it may concern are looked at."""
    columns = part.column("state").flatten()
    state = {n: c.to_numpy(False).copy() for n, c in zip(_STATE, columns, strict=True)}
    for name in ("class_distance", "word_distance"):
        state[name][state[name] == -1.0] = np.inf
    langs = part.column("lang").to_pylist()
    if own:
        rows = [at for at, lang in enumerate(langs) if lang in known.classes or lang is None]
    else:
        rows = np.flatnonzero(state["judged"] & ~state["kept"] & ~state["base_failed"]).tolist()
    if rows:
        texts = text_bytes(part.column("text").take(pa.array(rows)))
        before = {n: state[n][rows] for n in ("class_distance", "word_distance", "judged")}
        found = _judge(texts, [langs[at] for at in rows], known, own, not own, before)
        for name, values in found.items():
            state[name][rows] = values
    return _arrays(state)


def _verdict(known: References, first: bool, own: bool, others: bool, *columns: Column) -> Column:
    """Counts, distances and the verdict of each row's text, as one struct.

    ``columns``: text, lang and, but for the first block, the struct of those before.
    """

    def swept(*given: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(given), names=["text", "lang", "state"][: len(given)])
        parts = [
            _first(part, known, others) if first else _further(part, known, own)
            for part in slices([batch], "text")
        ]
        kind = pa.struct(list(_STATE.items()))
        return pa.concat_arrays([part.cast(kind) for part in parts]) if parts else pa.array([], kind)

    def one(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return swept(texts, langs)

    def more(texts: pa.Array, langs: pa.Array, state: pa.Array) -> pa.Array:
        return swept(texts, langs, state)

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = ", ".join(f"{name}: {kinds[kind]}" for name, kind in _STATE.items())
    return F.arrow_udf(one if first else more, f"struct<{schema}>")(*columns)


def judged(documents: DataFrame) -> DataFrame:
    """Each document as one struct ``row``, with its verdict ``v``."""
    table = references(documents)
    blocks = max(1, -(-table.count() // LANGS))
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    given = [F.col("row.text"), F.col("row.lang")]
    found = rows.select("row", _verdict(_block(table, blocks, 0), True, True, blocks == 1, *given).alias("v"))
    if blocks == 1:
        return found
    given.append(F.col("v"))
    for own in (True, False):
        for number in range(1 if own else 0, blocks):
            verdict = _verdict(_block(table, blocks, number), False, own, not own, *given)
            found = settle(found.select("row", verdict.alias("v")), "judged")
    return found


def quality_report(documents: DataFrame) -> DataFrame:
    """One row per document with its counts, distances and verdict.

    A distance of -1: nothing to compare with.
    """
    found = judged(documents.select("doc_id", "text", "lang"))
    return found.select("row.doc_id", *[F.col(f"v.{name}").alias(name) for name in _FIELDS])


def drop_rejected(documents: DataFrame) -> DataFrame:
    """The documents that no rule rejects."""
    return judged(documents).where("v.kept").select("row.*")
