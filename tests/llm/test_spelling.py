from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from shelflight.llm import common, spelling
from tests.llm.conftest import DDL


def brute(rows, eroded):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % eroded == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        first = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = first if first and n[first] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DDL)


def texts(seed, alphabet):
    draw = random.Random(seed)
    words = ["".join(draw.choice(alphabet) for _ in range(draw.choice([4, 5, 6, 7, 9]))) for _ in range(25)]
    for word in list(words):
        at = draw.randrange(len(word))
        words += [word[:at] + draw.choice(alphabet) + word[at:], word[:at] + word[at + 1 :]]
        words += [word[:at] + draw.choice(alphabet) + word[at + 1 :]]
    weight = [draw.choice([1, 1, 2, 5, 12, 30]) for _ in words]
    return [" ,1".join(draw.choices(words, weight, k=60)) for _ in range(25)]


@pytest.mark.parametrize("alphabet, eroded", [("abE", 97), ("abcdefÀéß×", 3), ("aaab", 5)])
def test_equals_brute_force(spark, alphabet, eroded):
    rows = list(enumerate(texts(len(alphabet), alphabet)))
    rows += [(None, rows[0][1]), (None, None), (5, ""), (3, rows[3][1]), (3, rows[3][1]), (-1, "12 . ")]
    found = spelling.spelling_variants(table(spark, rows), eroded)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute(rows, eroded)))


def test_chains_end_at_the_last_form(spark):
    # Each word one letter from the next and half as frequent.
    words = ["abcdefgh"]
    for at in range(6):
        words.append(words[-1][:at] + "z" + words[-1][at + 1 :])
    text = " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i))
    found = {r.word: r for r in spelling.spelling_variants(table(spark, [(1, text)]), 10**9).collect()}
    assert {r.root for r in found.values()} == {words[-1]}
    assert [found[w].form for w in words[:-1]] == words[1:]
    assert found[words[-1]].form is None


def test_ties_go_to_the_smallest_word(spark):
    text = "abcde " * 3 + "abcdz " * 6 + "abcdf " * 6 + "abcdé " * 6
    found = {r.word: r for r in spelling.spelling_variants(table(spark, [(1, text)]), 10**9).collect()}
    assert found["abcde"].form == "abcdf" and found["abcde"].n_near == 3


@pytest.mark.parametrize("parts", [6])
def test_parts_change_nothing(spark, parts):
    docs = table(spark, list(enumerate(texts(5, "abcdefg"))))
    usual = spelling.spelling_variants(docs).collect()
    assert sorted(map(str, spelling.spelling_variants(docs, parts=parts).collect())) == sorted(map(str, usual))


def test_no_words_are_broadcast(spark, monkeypatch):
    # Spark's own limit, under which every table of this test would be broadcast.
    monkeypatch.setattr(spelling, "settle", lambda table, label: settled.append(table) or settle(table, label))
    settled, settle = [], common.settle
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = spelling.spelling_variants(table(spark, list(enumerate(texts(4, "abcd")))))
        assert found.collect()
        # The words, the forms, and the words with a form, of one round at least.
        assert len(settled) >= 3
        for plan in (t._jdf.queryExecution().executedPlan().toString() for t in [*settled, found]):
            assert "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_words_and_empty_tables(spark):
    long = "ab" * 40_000
    rows = [(i, f"{long} {long}x") for i in range(3)]
    found = spelling.spelling_variants(table(spark, rows), 10**9).collect()
    assert [(len(r.word), r.n_near, r.form) for r in sorted(found, key=lambda r: len(r.word))] == [
        (80_000, 1, None),
        (80_001, 1, None),
    ]
    assert spelling.spelling_variants(table(spark, [])).collect() == []
    assert spelling.spelling_variants(table(spark, [(1, "so few")])).collect() == []


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = list(enumerate(texts(9, "abcd")))
    monkeypatch.setattr(spelling, "_HELD", 5)
    docs = table(spark, rows)
    batches = docs.selectExpr("doc_id as id", "text").toArrow().to_batches()
    parts = list(spelling._count(batches, 97))
    assert len(parts) > 3
    totals = Counter()
    for part in parts:
        totals.update(dict(zip(part["word"].to_pylist(), part["n"].to_pylist())))
    kept = {w: n for w, n in totals.items() if len(w) >= 5 and n >= 3}
    assert kept == {w: n for w, _, _, n, _, _ in brute(rows, 97)}
