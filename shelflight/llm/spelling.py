"""Spelling variants: words one edit apart, found by PartEnum signatures, and their forms.

A word's letters are a multiset, seen as a binary vector with one place for each
(letter, n-th occurrence). Two words one replaced letter apart differ in two places,
one inserted letter apart in one. The alphabet is cut into parts of about equal use;
of PARTS parts at most two differ, so some choice of PARTS - 2 parts is equal in both
words (with one place: of two parts one). Each choice of parts, enumerated, gives a
signature: the letters of the chosen parts, sorted. An edit also lies in one half of
a word and leaves the other half as it is, so a signature carries that half too, once
for each side. Words of equal length and words one letter apart in length have
signatures of their own. Equal signatures are joined, and every joined pair is
verified by its edit distance. Neither the parts nor the halves lose a pair.

Nulls: a null text has no words; a null doc_id counts as an empty text in the hash.
Repeated rows count as often as they stand there. Ties of a form go to the smallest
word by code point. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import lowered, settle, slices, text_bytes

# Letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
# One run in so many of a document loses a letter.
ERODED = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
# A form's count is at least so many times that of its word.
FORM_RATIO = 2
# Parts of the alphabet for words of equal length.
PARTS = 4
# Different words that a task counts before it hands them on.
_HELD = 300_000

_COUNTS = "word string, n bigint"


def _eroded(run: bytes, hashed: int) -> bytes:
    letters = run.decode()
    at = hashed % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _rows(counts: Counter) -> pa.RecordBatch:
    words = pa.array(list(counts), pa.binary()).cast(pa.string())
    return pa.record_batch([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _count(batches: Iterable[pa.RecordBatch], eroded: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for part in slices(batches, "text"):
        ids = part.column("id").to_pylist()
        for doc_id, text in zip(ids, text_bytes(part.column("text")), strict=True):
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(_RUN.findall(lowered(text))).items():
                hashed = zlib.crc32(run, prefix)
                if hashed % eroded == 0:
                    run = _eroded(run, hashed)
                # Bytes are at least as many as letters.
                if len(run) >= LEAST_LETTERS:
                    counts[run] += n
            if len(counts) > _HELD:
                yield _rows(counts)
                counts.clear()
    yield _rows(counts)


def word_counts(documents: DataFrame, eroded: int = ERODED) -> DataFrame:
    """(word, n) of all words long and frequent enough; counted per task, then summed."""
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    counted = texts.mapInArrow(partial(_count, eroded=eroded), _COUNTS)
    sums = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LETTERS))


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, never sent whole to the driver.

    All sides here grow with the words. Spark would take a written table for as small
    as its compressed files, and its signatures for as few rows as it has words.
    """
    return side.hint("merge")


# ---- signatures -----------------------------------------------------------------


def _alphabet(words: DataFrame, parts: int) -> list[str]:
    """The letters in parts of about equal use. An alphabet has at most 126 letters."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    used = letters.groupBy("letter").count().collect()
    load, cut = [0] * parts, [""] * parts
    for row in sorted(used, key=lambda r: (-r["count"], r.letter)):
        least = load.index(min(load))
        load[least] += row["count"]
        cut[least] += row.letter
    return cut


def _signed(words: DataFrame, shorter: Column, parts: list[str], distance: int) -> DataFrame:
    """(key, word, n): the signatures of each word for partners of some length.

    ``shorter``: the letters of the shorter word of such a pair. A signature for each
    choice of all but ``distance`` parts, and for each half that may be equal.
    """
    given = words.select(
        "word",
        "n",
        shorter.alias("shorter"),
        F.floor(shorter / 2).cast("int").alias("half"),
        F.array_join(F.array_sort(F.split("word", "")), "").alias("letters"),
    )
    halves = (
        F.left(F.col("word"), F.col("half")),
        F.right(F.col("word"), F.col("shorter") - F.col("half")),
    )
    keys = []
    for left_out in combinations(range(len(parts)), distance):
        gone = "".join(parts[p] for p in left_out)
        chosen = F.translate("letters", gone, "")
        for side, kept in enumerate(halves):
            keys.append(F.xxhash64(F.lit(f"{left_out}{side}"), F.col("shorter"), kept, chosen))
    return given.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def _joined(left: DataFrame, right: DataFrame, *also: Column) -> DataFrame:
    """Verified pairs of equal signatures."""
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    same = F.col("a.key") == F.col("b.key")
    pairs = left.alias("a").join(_shuffled(right.alias("b")), [same, *also, near])
    return pairs.select(
        F.col("a.word").alias("word"),
        F.col("a.n").alias("n"),
        F.col("b.word").alias("other"),
        F.col("b.n").alias("other_n"),
    )


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, once in each direction."""
    size = F.char_length("word")
    cut = _alphabet(words, parts)
    same = _signed(words, size, cut, 2)
    replaced = _joined(same, same, F.col("a.word") < F.col("b.word"))
    # Two parts for the letter that only one of them has.
    two = ["".join(cut[0::2]), "".join(cut[1::2])]
    shorter, longer = _signed(words, size, two, 1), _signed(words, size - 1, two, 1)
    pairs = replaced.unionAll(_joined(shorter, longer)).distinct()
    back = pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
        F.col("n").alias("other_n"),
    )
    return pairs.unionAll(back)


# ---- forms ----------------------------------------------------------------------


def _forms(pairs: DataFrame) -> DataFrame:
    """Per word its number of near words and, if frequent enough, the first of them."""
    first = F.min(F.struct((-F.col("other_n")).alias("order"), "other", "other_n"))
    best = pairs.groupBy("word").agg(
        F.first("n").alias("n"), F.count("*").alias("n_near"), first.alias("best")
    )
    enough = F.col("best.other_n") >= F.col("n") * FORM_RATIO
    return best.select(
        "word",
        "n_near",
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, F.col("best.other_n")).alias("form_n"),
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word of the chain of forms.

    Each round doubles the steps taken. Counts at least double along a chain, so a
    chain has at most as many words as a count has bits, and no circle.
    """
    now = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        now = settle(now, "roots")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = now.join(_shuffled(onward), "root", "left")
        if stepped.where("next is not null").isEmpty():
            return now
        now = stepped.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(
    documents: DataFrame, eroded: int = ERODED, parts: int = PARTS
) -> DataFrame:
    """Per word: form, root, n, n_near, form_n."""
    words = settle(word_counts(documents, eroded), "words")
    forms = settle(_forms(near_pairs(words, parts)), "forms")
    every = words.join(_shuffled(forms), "word", "left")
    every = every.join(_shuffled(_roots(forms)), "word", "left")
    return every.select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )
