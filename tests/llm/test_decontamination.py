from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from shelflight.llm import decontamination
from tests.llm.conftest import DDL, ODD_TEXTS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(documents, items, size):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(len(words) - size, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[at : at + size]), set()).add("" if item is None else str(item))
    rows = []
    for doc_id, text in documents:
        words, hit, named = words_of(text), set(), set()
        for length in {len(w) for w in windows}:
            for at in range(len(words) - length + 1):
                if (of := windows.get(tuple(words[at : at + length]))) is not None:
                    hit.update(range(at, at + length))
                    named |= of
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        rows.append((doc_id, len(words), len(hit), len(named), digest, bool(hit)))
    return rows


def tables(spark, documents, items):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in documents], DDL)
    return docs, spark.createDataFrame(items, "item_id bigint, text string")


def case(seed):
    draw = random.Random(seed)
    items = [(i, prose(seed * 100 + i, draw.choice([1, 3, 10, 12, 30]))) for i in range(12)]
    items += [(None, "Ünïcode, ONE-two"), (77, None), (78, " .. "), (3, prose(1, 15)), (80, items[4][1])]
    documents = []
    for i in range(30):
        text = prose(900 + i, draw.randrange(60))
        for _ in range(draw.randrange(3)):
            words = (draw.choice(items)[1] or "").split()
            cut = draw.randrange(len(words) + 1)
            text += draw.choice([" ", "\n", "--"]) + "; ".join(words[cut // 2 :]).upper()
        documents.append((i, text))
    documents += [(None, documents[3][1]), (4, documents[4][1]), *enumerate(ODD_TEXTS)]
    return documents, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [8 << 20, 900, 150])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    documents, items = case(seed)
    for size in (10, 4):
        found = decontamination.contamination(*tables(spark, documents, items), words=size)
        expected = brute(documents, items, size)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
        assert 0 < sum(row[-1] for row in expected) < len(expected)


def test_spans_are_the_hit_words(spark):
    docs, items = tables(
        spark, [(1, "x one two three y three four two THREE-four z")], [(5, "one two three"), (6, "two three four")]
    )
    row = decontamination.contaminated_spans(docs, items, words=3).first()
    assert row.spans == [1, 4, 7, 10] and row["items"] == ["5", "6"] and row.n_words == 11


def test_clean_rows_stay_whole(spark):
    documents, items = case(3)
    docs, bench = tables(spark, documents, items)
    extra = docs.selectExpr("*", "'x' as n_words", "'y' as items", "1 as row", "2 as spans", "3 as n_hit")
    kept = decontamination.drop_contaminated(extra, bench)
    assert kept.columns == extra.columns
    expected = [row[0] for row in brute(documents, items, 10) if not row[-1]]
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, expected))


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "one two")], [(1, "one two")])
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    for none in (items.limit(0), items.selectExpr("item_id", "'..' as text")):
        row = decontamination.contamination(docs, none).first()
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
        assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefgh "])
def test_search_finds_every_occurrence(letters):
    draw = random.Random(len(letters))
    text = bytes(draw.choice(letters) for _ in range(5000))
    patterns = {text[at : at + draw.randrange(1, 40)] for at in draw.choices(range(4900), k=60)}
    patterns = sorted(patterns | {b"zz", b"abz"})
    eights = decontamination._eights(np.frombuffer(text + bytes(8), np.uint8))
    found = set()
    for table in decontamination.searchers(patterns):
        places, numbers = table.search(text, eights)
        pairs = list(zip(places.tolist(), numbers.tolist()))
        assert len(pairs) == len(set(pairs))
        found |= set(pairs)
    expected = {
        (at, n) for n, p in enumerate(patterns) for at in range(len(text)) if text.startswith(p, at)
    }
    assert found == expected


def test_shifts_skip_most_places():
    """A text without any block of the patterns is passed in steps of almost their length."""
    table = decontamination.searchers([b" the quick brown fox jumps over the lazy dog now "])[0]
    text = bytes(range(128, 250)) * 100
    calls = []
    hashed = table._hash
    table._hash = lambda eights: calls.append(len(eights)) or hashed(eights)
    table.search(text, decontamination._eights(np.frombuffer(text + bytes(8), np.uint8)))
    assert sum(calls) < len(text) / 30
