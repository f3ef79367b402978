from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ba", "ne", "to", "ri") for b in ("lo", "mu", "se") for c in ("n", "st", "")]

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents_of(spark):
    """Documents from texts, or from (text, source) pairs; ids in order."""

    def build(texts, first=0):
        rows = []
        for at, given in enumerate(texts):
            text, source = given if isinstance(given, tuple) else (given, "s")
            rows.append((first + at, text, "en", source, len(text or "")))
        return spark.createDataFrame(rows, DDL)

    return build


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(words))


ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "one two",
    "one two three",
    "x" * 200_000,
    "word " * 30_000,
    "line\n" * 500,
    "日本語 \U0001f600 café",
    "same text",
    "same text",
    "a\x00b <|endoftext|> c",
]
