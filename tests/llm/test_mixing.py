from __future__ import annotations

from collections import Counter

import pytest

from shelflight.llm import mixing
from tests.llm.conftest import DDL, ODD_TEXTS, prose
from tests.llm.test_pipeline import plain_mix


def docs():
    rows = [(i, text, f"s{i % 3}") for i, text in enumerate(ODD_TEXTS)]
    rows += [(100 + i, prose(i, 5 + i % 40), "hot") for i in range(200)]
    rows += [(400 + i, prose(i, 30), None if i % 2 else "") for i in range(20)]
    return [*rows, (500, "", "empty"), (501, None, "empty"), (502, "w " * 5000, "one long")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DDL)


@pytest.mark.parametrize("range_rows", [4000, 3])
def test_matches_brute_force(spark, range_rows):
    rows = docs()
    found = mixing.mix_report(table(spark, rows), range_rows=range_rows).collect()
    assert {r.doc_id: r.copies for r in found} == plain_mix(rows)
    assert len(found) == len(rows)
    assert all(r.taken == r.copies * r.size <= 2 * r.size and r.target <= 2 * r.source_size for r in found)
    longest = max(r.size for r in found)
    taken, target = Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= longest / 2 for s in target)


def test_mix_repeats_rows(spark):
    rows = docs()
    out = Counter(r.doc_id for r in mixing.mix(table(spark, rows), range_rows=5).collect())
    assert out == +Counter(plain_mix(rows))


def taken_of(spark, rows, **plan):
    """Words taken and target by source."""
    taken, target = Counter(), {}
    given = table(spark, rows).repartition(7)
    source = {i: s for i, _, s in rows}
    for r in mixing.mix_report(given, **plan).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    return taken, target


@pytest.mark.parametrize("range_rows", [4000, 3])
def test_equal_rows_are_taken_up_to_the_target(spark, range_rows):
    rows = [(7, "one two three four", "hot")] * 3000 + [(i, "a b c", "cold") for i in range(20, 90)]
    rows += [(7, "one two", "hot")] * 50 + [(None, "x y", "hot")] * 40
    taken, target = taken_of(spark, rows, range_rows=range_rows)
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert 0 < target["hot"] < 2 * 12_180


def test_some_rows_of_a_spot_are_taken(spark):
    rows = [(1, "w", "s")] * 100 + [(2, "w", "t")] * 10
    copies = Counter(r.copies for r in mixing.mix_report(table(spark, rows)).collect() if r.doc_id == 1)
    out = Counter(r.source for r in mixing.mix(table(spark, rows)).collect())
    taken, target = taken_of(spark, rows)
    assert len(copies) == 2 and max(copies) - min(copies) == 1
    assert out["s"] == taken["s"] == round(target["s"])


def test_a_hot_spot_is_numbered_in_parts(spark):
    rows = spark.range(0, 3000, 1, 6).selectExpr("'' as key", "false as unnamed", "id")
    found = mixing._numbered(rows).orderBy("id").collect()
    assert sorted(r.nth for r in found) == list(range(1, 3001))


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_prefixes_in_two_levels(spark, digits):
    ranges = [f"{n:03x}"[:digits] for n in range(0, 4096, 37)]
    sums = Counter()
    for at, name in enumerate(ranges):
        sums[name] += at
    given = [("a", False, name, n) for name, n in sums.items()] + [("", True, name, 1) for name in sums]
    table_of = spark.createDataFrame(given, "key string, unnamed boolean, range string, in_range bigint")
    found = {(r.key, r.range): r.start for r in mixing._starts(table_of, digits).collect()}
    upto = 0
    for at, name in enumerate(sorted(sums)):
        assert found["a", name] == upto and found["", name] == at
        upto += sums[name]


def test_empty(spark):
    assert mixing.mix_report(table(spark, [])).collect() == []
    assert mixing.mix(table(spark, [])).collect() == []
