from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from shelflight.llm import packing
from shelflight.llm.tokens import library, tokenizer_path
from tests.llm.conftest import ODD_TEXTS, prose


def plain_pieces(texts, capacity=2048):
    lib, out = library(tokenizer_path()), {}
    for doc_id, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, piece] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def check(rows, expected, capacity=2048):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(documents_of):
    texts = [*ODD_TEXTS, *[prose(s, 30 + 7 * s) for s in range(60)]]
    expected = plain_pieces(texts)
    used = check(packing.pack_documents(documents_of(texts)).collect(), expected)
    least = -(-sum(length for _, length, _ in expected.values()) // 2048)
    assert used <= least + 1


def test_rounds_merge_leftovers(spark):
    sizes = [(7 * i * i) % 60 + 1 for i in range(800)]
    rows = spark.createDataFrame(
        [(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing._PIECE.format(kind="bigint")
    )
    found = packing.packed(rows, capacity=100, slack=0.02, items=40).collect()
    used = check(found, {(i, 0): (0, n, 0) for i, n in enumerate(sizes)}, 100)
    assert used <= -(-sum(sizes) // 100) * 1.02 + 1


def test_rows_of_one_doc_id_are_dealt_evenly(spark):
    rows = spark.range(0, 4_000, 1, 4).selectExpr(
        "if(id % 2 = 0, null, 7L) as doc_id", "0 as piece", "0L as start", "5L as length",
        "9L as ids_crc32",
    )
    dealt = packing._items(rows).repartition(8, "order").selectExpr("spark_partition_id() as p")
    sizes = [r["count"] for r in dealt.groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_no_round_exceeds_its_partitions(spark, monkeypatch):
    """Small items leave so little full that most of them go through several rounds."""
    usual = packing._pack

    def bounded(batches, capacity, least):
        table = list(batches)
        assert sum(b.num_rows for b in table) <= 150
        return usual(iter(table), capacity=capacity, least=least)

    monkeypatch.setattr(packing, "_pack", bounded)
    rows = spark.range(0, 6400, 1, 4).selectExpr(
        "id as doc_id", "0 as piece", "0L as start", "400 + (id * 37) % 700 as length", "9L as ids_crc32"
    )
    lengths = {(r.doc_id, 0): (0, r.length, 9) for r in rows.collect()}
    found = packing.packed(rows, capacity=2048, items=100).collect()
    used = check(found, lengths, 2048)
    # A partition of 100 items packs less tightly than one of 50,000.
    assert used <= -(-sum(n for _, n, _ in lengths.values()) // 2048) * 1.1


def test_large_items_end_the_rounds(spark):
    rows = spark.createDataFrame(
        [(i, 0, 0, 60, 0) for i in range(300)], packing._PIECE.format(kind="bigint")
    )
    found = packing.packed(rows, capacity=100, items=10).collect()
    assert check(found, {(i, 0): (0, 60, 0) for i in range(300)}, 100) == 300


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([5, 3, 6, 4, 2], 10) == [[2, 3], [0, 1, 4]]


def test_empty(documents_of):
    assert packing.pack_documents(documents_of([])).collect() == []
