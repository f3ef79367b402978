from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelflight.llm import exact_dedup
from tests.llm.conftest import DDL, ODD_TEXTS, prose


def plain(texts):
    groups = {}
    for i, text in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append(i)
    rows = {}
    for normal, own in groups.items():
        keep = min(own, key=lambda i: (-len(texts[i] or ""), i))
        sha = hashlib.sha256(normal.encode()).hexdigest()
        rows |= {i: (keep, len(own), i == keep, sha) for i in own}
    return rows


TEXTS = [*ODD_TEXTS, *[prose(s % 5, 40) + " " * (s % 3) for s in range(40)], "a b", "ab", " a\nb", "a b"]


def found(groups):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in groups.collect()}


@pytest.mark.parametrize("salts", [1, 3])
def test_matches_brute_force(documents_of, salts):
    table = documents_of(TEXTS).repartition(7)
    assert found(exact_dedup.exact_groups(table, salts)) == plain(TEXTS)


def test_texts_of_one_digest_stay_apart(documents_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda normal: F.sha2(F.length(normal).cast("string"), 256))
    expected = {i: row[:3] for i, row in plain(TEXTS).items()}
    rows = found(exact_dedup.exact_groups(documents_of(TEXTS)))
    assert {i: row[:3] for i, row in rows.items()} == expected


def test_one_row_of_each_group_stays(spark, documents_of):
    table = documents_of(TEXTS)
    left = exact_dedup.drop_exact_copies(table.union(table)).collect()
    assert sorted(r.doc_id for r in left) == sorted(i for i, row in plain(TEXTS).items() if row[2])
    same_id = spark.createDataFrame([(1, "a b", "x", "y", 1), (1, "ab", "x", "y", 1), (-5, "ab ", "", "", 0)], DDL)
    assert [(r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(same_id).collect()] == [(-5, "ab ")]


def test_empty_and_extremes(spark, documents_of):
    assert exact_dedup.exact_groups(documents_of([])).collect() == []
    ids = [(-(2**63), "t"), (2**63 - 1, "t"), (None, "t"), (None, "u")]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in ids], DDL)
    rows = exact_dedup.exact_groups(table).collect()
    assert sorted((r.group_size, r.kept, r.keep_id) for r in rows if r.keep_id is not None) == [
        (3, False, -(2**63)), (3, False, -(2**63)), (3, True, -(2**63))
    ]
    assert [(r.doc_id, r.kept) for r in rows if r.keep_id is None] == [(None, True)]


def test_no_python_in_the_plan(documents_of):
    plan = exact_dedup.exact_groups(documents_of(TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
