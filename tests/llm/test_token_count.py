from __future__ import annotations

import random

from shelflight.llm import token_count
from shelflight.llm.tokens import library, tokenizer_path
from tests.llm.conftest import ODD_TEXTS, prose

PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "\r", "'s", "'LL", "1", "²", "Ⅷ", " ", "　",
         "\x1c", "\x85", "<|endoftext|>", "<|", ".", ",", "日", "\U0001f600", "\x00", "_", "xyz" * 20,
         "hello", "tion", "ा", "×", "÷", "ª"]


def test_counts_are_the_librarys():
    draw = random.Random(4)
    lib, own = library(tokenizer_path()), token_count.Counter(tokenizer_path())
    for _ in range(4000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        assert own.count([text.encode()])[0] == len(lib.encode(text, add_special_tokens=False).ids), (
            repr(text)
        )


def test_documents(documents_of):
    lib = library(tokenizer_path())
    texts = [*ODD_TEXTS, *[prose(seed, 300) for seed in range(30)]]
    rows = token_count.token_counts(documents_of(texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512)


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_count, "TABLE_ENTRIES", 50)
    own, lib = token_count.Counter(tokenizer_path()), library(tokenizer_path())
    for seed in range(20):
        text = prose(seed, 100)
        assert own.count([text.encode()])[0] == len(lib.encode(text, add_special_tokens=False).ids)


def test_empty(documents_of):
    assert token_count.token_counts(documents_of([])).collect() == []
