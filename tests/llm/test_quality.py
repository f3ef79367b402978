from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from shelflight.llm import quality
from tests.llm.conftest import DDL, ODD_TEXTS, prose


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {
        j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)
    }
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


GOOD = [prose(seed, 200) + " the and of" * 10 for seed in range(40)]
BAD = [
    " ".join(w.upper() + "!!" for w in prose(90, 200).split()),
    " ".join(w + "###" for w in prose(91, 200).split()),
]
REPEATS = [" ".join(prose(s, 9).split() * 6) for s in (1, 2)] + ["a b\n" * 30, "x\r\nx\r\ny"]


def test_counts_match_brute_force(documents_of):
    texts = [*ODD_TEXTS, *REPEATS, *GOOD]
    rows = quality.quality_report(documents_of(texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = plain_counts(texts[row.doc_id])
        assert {name: row[name] for name in expected} == expected


def test_divergent_documents_go(documents_of):
    texts = [*GOOD, *BAD]
    kept = {r.doc_id for r in quality.drop_rejected(documents_of(texts)).collect()}
    assert kept == set(range(len(GOOD)))


def test_short_documents_are_not_judged_by_divergence(documents_of):
    short = " ".join(f"w{i}!" for i in range(25))
    rows = quality.quality_report(documents_of([*GOOD, short])).collect()
    assert all(r.kept for r in rows)


def test_wrong_language_is_forgiven_and_null_columns_pass(spark):
    rows = [(i, text, "aa", "s", 1) for i, text in enumerate(GOOD)]
    rows += [(100 + i, "".join(chr(ord(c) + 400) if c > " " else c for c in t), "bb", None, None)
             for i, t in enumerate(GOOD)]
    rows += [(200, GOOD[0], "bb", "s", 1), (201, GOOD[1], None, "s", 1), (None, GOOD[2], "zz", "s", 1)]
    kept = [r.doc_id for r in quality.drop_rejected(spark.createDataFrame(rows, DDL)).collect()]
    assert {200, 201, None} <= set(kept) and len(kept) == len(rows)


def shifted(text, by):
    return "".join(chr(ord(c) + by) if c > " " else c for c in text)


def test_small_languages_have_references_of_their_own(spark):
    """"bb" has 0.06 of the words."""
    rows = [(i, prose(5_000 + i, 400) + " the and of" * 20, "aa", "s", 1) for i in range(320)]
    rows += [(1_000 + i, shifted(t, 400), "bb", "s", 1) for i, t in enumerate(GOOD)]
    rows += [(2_000 + i, t, "bb", "s", 1) for i, t in enumerate(BAD)]
    # Too few words for a reference: not held against foreign ones.
    rows += [(3_000, shifted(GOOD[0], 800), "cc", "s", 1), (3_001, "few words", "cc", "s", 1)]
    found = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, DDL)).collect()}
    assert len(found) == len(rows)
    assert all(found[1_000 + i].kept and found[1_000 + i].word_distance < 0.2 for i in range(len(GOOD)))
    assert not any(found[2_000 + i].kept for i in range(len(BAD)))
    assert found[3_000].kept and found[3_000].word_distance == -1 and not found[3_001].kept


def test_languages_below_a_thousandth_of_all_words_are_kept(spark):
    rows = [(i, GOOD[i % 40] + " " + GOOD[(i + 7) % 40], "aa", "s", 1) for i in range(25_000)]
    rows += [(100_000 + i, shifted(t, 400), "bb", "s", 1) for i, t in enumerate(GOOD)]
    kept = quality.drop_rejected(spark.createDataFrame(rows, DDL)).where("lang = 'bb'")
    assert kept.count() == len(GOOD)


def many_languages():
    """Five languages, wrong and missing labels, junk and short texts."""
    rows = []
    for at, lang in enumerate(("aa", "bb", "cc", "dd", "ee")):
        rows += [(1000 * at + i, shifted(t, 300 * at), lang, "s", 1) for i, t in enumerate(GOOD)]
        rows += [(1000 * at + 500 + i, t, lang, "s", 1) for i, t in enumerate(BAD)]
        rows += [(1000 * at + 700 + i, shifted(GOOD[i], 300 * (4 - at)), lang, "s", 1) for i in range(5)]
    rows += [(9000 + i, shifted(GOOD[i], 300 * i), None, "s", 1) for i in range(5)]
    return rows + [(9100, BAD[0], None, "s", 1), (9101, GOOD[0], "none such", "s", 1), (9102, "a", "cc", "s", 1)]


def verdicts(spark, rows):
    found = quality.quality_report(spark.createDataFrame(rows, DDL)).collect()
    return {r.doc_id: r.kept for r in found}


def test_other_languages_change_no_verdict(spark):
    """Neither a language's share of the corpus nor how many others there are decides."""
    rows = many_languages()
    alone = verdicts(spark, rows)
    other = [(50_000 + i, shifted(GOOD[i % 40] + " " + GOOD[(i + 7) % 40], 2_000), "xx", "s", 1) for i in range(9_000)]
    beside = verdicts(spark, rows + other)
    assert {i: beside[i] for i in alone} == alone
    # A wrong or missing label is no reason to go.
    assert all(alone[1000 * at + 700 + i] for at in range(5) for i in range(5))
    assert all(alone[9000 + i] for i in range(5)) and not alone[9100] and alone[9101]
    assert not any(alone[1000 * at + 500 + i] for at in range(5) for i in range(len(BAD)))


@pytest.mark.parametrize("langs", [1, 2])
def test_blocks_of_languages_change_no_verdict(spark, monkeypatch, langs):
    rows = many_languages()
    usual = verdicts(spark, rows)
    monkeypatch.setattr(quality, "LANGS", langs)
    assert verdicts(spark, rows) == usual


def test_distance_is_that_of_its_definition():
    p, q = np.array([1, 3, 0, 4]), np.array([0.25, 0.25, 0.5, 0.0])
    own = p / p.sum()
    m = (own + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert np.isclose(quality.js_distance(p[None], q)[0], np.sqrt((kl(own) + kl(q)) / 2))


def test_empty_table(documents_of):
    assert quality.quality_report(documents_of([])).collect() == []
    assert quality.drop_rejected(documents_of([])).collect() == []
