from __future__ import annotations

import math
import random

import numpy as np
import pytest

from shelflight.llm import hard_negatives as hn

DDL = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 8, 32), (33, 9, 17), (64, 64, 64), (5, 0, 4), (0, 3, 4)])
@pytest.mark.parametrize("leaf", [1, 4])
def test_products_are_exact(shape, leaf):
    n, k, m = shape
    draw = np.random.default_rng(n + k + m)
    a, b = draw.integers(-(2**25), 2**25, (n, k)), draw.integers(-(2**25), 2**25, (k, m))
    assert (hn.strassen(a, b, leaf) == a @ b).all()
    assert hn.strassen(a, b, leaf).shape == (n, m)


def test_heaps_merge_to_the_best():
    draw = random.Random(4)
    entries = [(draw.randrange(3), draw.randrange(4), draw.randrange(50)) for _ in range(200)]
    halves = []
    for part in (entries[:70], entries[70:]):
        heaps = hn.Heaps(3, 5)
        for at in range(0, len(part), 9):
            heaps.offer(*np.array(part[at : at + 9]).T)
        halves.append(heaps)
    merged = hn.Heaps(3, 5)
    for heaps in halves:
        merged.offer(*heaps.entries())
    for slot in range(3):
        best = sorted(((-s, i) for t, s, i in entries if t == slot))[:5]
        assert list(zip((-merged.score[slot]).tolist(), merged.id[slot].tolist())) == best


def brute(rows):
    taken = set()
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        if sum(x * x for x in scaled) >= 2**56:
            continue
        taken.add((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, scaled))

    def order(pair):
        score, row = pair
        return -score, row[0] is None, row[0] or 0

    found = []
    for anchor in taken:
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(anchor[2], row[2])), row) for row in taken if row != anchor]
        alike = sorted((p for p in scored if p[1][1] == anchor[1]), key=order)[:5]
        for score, positive in alike:
            window = [p for p in scored if p[1][1] != anchor[1] and 80 * score <= 100 * p[0] <= 100 * score]
            for rank, (value, row) in enumerate(sorted(window, key=order)[:5], 1):
                found.append((anchor[0], positive[0], rank, row[0], score, value))
    return found


def vectors(seed, count, width=6, labels=3, values=None):
    draw = random.Random(seed)
    values = values or [x / 64 for x in range(-40, 100)]
    return [
        (i, [draw.choice(values) for _ in range(width)], draw.randrange(labels)) for i in range(0, 10 * count, 10)
    ]


ODD = [
    (None, [1.0, 0.5], 1),
    (None, [1.0, 0.5], 1),
    (None, [1.0, 0.5, 0.25], 2),
    (300, [0.5, 1.0, 0.25, 1.0, 0.0, 0.5], 1),
    (300, [0.5, 1.0, 0.25, 1.0, 0.0, 0.5], 1),
    (300, [0.5, 1.0, 0.25, 1.0, 0.0, 0.25], 2),
    (400, None, 1),
    (500, [1.0, float("nan")], 1),
    (600, [1.0, float("inf")], 1),
    (601, [1.0, None], 1),
    (602, [1.0], None),
    (700, [], 0),
    (1400, [1e9], 1),
    (-100, [0.75] * 6, 1),
    (2**62, [0.5] * 6, 2),
    (2**63 - 8, [0.25] * 9, -3),
]


@pytest.mark.parametrize("given", [
    vectors(1, 80),
    vectors(2, 60, labels=1),
    vectors(3, 80, values=[0.0, 1.0]),
    vectors(4, 60, values=[0.5]),
    vectors(5, 50) + ODD + vectors(6, 3),
])
@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, given, small):
    if small:
        # Several blocks, tiles and files.
        for name, value in (("BLOCK_BYTES", 2000), ("_FILE_ROWS", 20)):
            monkeypatch.setattr(hn, name, value)
    found = hn.hard_negatives(spark.createDataFrame(given, DDL)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(given)))


def test_tiles_cut_anchors_and_rows(monkeypatch):
    given = vectors(8, 60)
    monkeypatch.setattr(hn, "TILE_ANCHORS", 2)
    monkeypatch.setattr(hn, "TILE_ROWS", 7)
    ids = np.array([r[0] for r in given])
    rows = hn.Tile(ids, np.array([r[2] for r in given]), np.array([[math.floor(256 * x) for x in r[1]] for r in given]))
    anchors = hn.Tile(*[column[:5] for column in (rows.ids, rows.labels, rows.vectors)])
    heaps = hn.Heaps(5, 3)
    for at in range(0, 60, 7):
        tile = rows.part(at, 7)
        for first, part, scores in hn._pairs(anchors, tile):
            a, r = np.nonzero(np.ones_like(scores, bool))
            heaps.offer(a + first, scores[a, r], tile.ids[r])
    scores = anchors.vectors @ rows.vectors.T
    for a in range(5):
        best = sorted(zip((-scores[a]).tolist(), ids.tolist()))[:3]
        assert list(zip((-heaps.score[a]).tolist(), heaps.id[a].tolist())) == best


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], DDL)
    assert hn.hard_negatives(none).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], DDL)).collect() == []
    given = spark.createDataFrame(vectors(1, 40), DDL)
    names = ["vector", "slot", "score", "id", "rank", "anchor_id", "block", "size"]
    extra = given.selectExpr("*", *[f"'x' as {name}" for name in names])
    usual = sorted(map(str, hn.hard_negatives(given).collect()))
    assert sorted(map(str, hn.hard_negatives(extra).collect())) == usual
