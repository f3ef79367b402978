from __future__ import annotations

import heapq
import random
import zlib

import numpy as np

from shelflight.llm import token_files as tf
from shelflight.llm import tokens
from shelflight.llm.tokens import Encoder, library, tokenizer_path
from tests.llm.conftest import ODD_TEXTS, prose


def plain_cost(counts):
    """Cost of an unlimited Huffman code."""
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_optimal_and_limited():
    draw = random.Random(5)
    for _ in range(30):
        counts = np.array([draw.randint(1, 10 ** draw.randint(1, 6)) for _ in range(draw.randint(2, 60))])
        free = tf.code_lengths(counts, 60)
        assert (counts * free).sum() == plain_cost(counts.tolist())
        tight = tf.code_lengths(counts, 6)
        assert tight.max() <= 6
        assert sum(2.0**-n for n in tight) == 1.0
        assert (counts * tight).sum() >= (counts * free).sum()


def test_bits_round_trip():
    draw = np.random.default_rng(1)
    used = np.sort(draw.choice(5_000, 300, replace=False))
    codes = tf.Codes(used, tf.code_lengths(draw.integers(1, 100_000, 300) ** 2, 16))
    parts = [used[draw.integers(0, 300, n)] for n in (1, 7, 64, 1000, 4097)]
    coded = [tf.encode(part, codes, 64) for part in parts]
    sizes = np.array([len(part) for part in parts])
    found = tf.decode([c[0] for c in coded], [c[1] for c in coded], sizes, codes, 64)
    assert found.tolist() == np.concatenate(parts).tolist()


def test_single_id():
    codes = tf.Codes(np.array([9]), tf.code_lengths(np.array([4]), 16))
    payload, offsets = tf.encode(np.array([9, 9, 9]), codes, 2)
    assert tf.decode([payload], [offsets], np.array([3]), codes, 2).tolist() == [9, 9, 9]


def plain(texts):
    lib, start, rows = library(tokenizer_path()), 0, {}
    for doc_id, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        rows[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return rows


def test_files_match_the_library(documents_of):
    texts = [*ODD_TEXTS, *[prose(seed, 400) for seed in range(40)]]
    found = tf.round_trip(documents_of(texts).repartition(5)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == plain(texts)
    assert len(found) == len(texts)


def test_small_segments_and_ids(spark, documents_of, tmp_path):
    texts = [prose(seed, 50) for seed in range(30)]
    tf.write_ids(documents_of(texts), str(tmp_path / "f"), segment=200, block=16)
    lib = library(tokenizer_path())
    for row in tf.read_ids(spark, str(tmp_path / "f"), block=16).collect():
        expected = lib.encode(texts[row.doc_id], add_special_tokens=False).ids + [0]
        assert np.frombuffer(row.ids, "<u4").tolist() == expected


def test_a_hot_doc_id_is_spread_over_shards(spark):
    rows = [(None if i % 3 == 0 else i, f"text number {i} " + "word " * (i % 7)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ids = docs.selectExpr("doc_id", "xxhash64(text) as text_key", "monotonically_increasing_id() as row")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = tf._ordered(ids).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2 * 6000 / 4
    found = tf.round_trip(docs).collect()
    lib = library(tokenizer_path())
    expected = {}
    for doc_id, text in rows:
        got = lib.encode(text, add_special_tokens=False).ids + [0]
        expected.setdefault(doc_id, []).append((len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
    shown = {}
    for r in found:
        shown.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in shown.items()} == {k: sorted(v) for k, v in expected.items()}
    # Starts follow each other without gaps, doc_ids never fall.
    upto = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == upto
        upto += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order) and found and min(found, key=lambda r: r.start).doc_id is None


def test_empty(documents_of):
    assert tf.round_trip(documents_of([])).collect() == []


def test_blocks_give_the_librarys_ids():
    draw = random.Random(2)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\r", "'s", "1", "²", " ", "　", "\x1c", "\x85",
             "<|endoftext|>", "<", ".", ",", "日", "\U0001f600", "\x00", "_", "x" * 60, "×", "÷"]
    path = tokenizer_path()
    own, lib = Encoder(path), library(path)
    for _ in range(3000):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3)]
        ids, counts = own.encode([text.encode() for text in texts])
        expected = [lib.encode(text, add_special_tokens=False).ids for text in texts]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(e) for e in expected]


def test_a_full_table_keeps_the_blocks_in_use(monkeypatch):
    """Blocks looked up often stay, their ids are the library's before and after; once-only ones go."""
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", 60)
    draw = random.Random(6)
    path = tokenizer_path()
    own, lib = Encoder(path), library(path)
    given = []
    fill = own._fill_in

    def noted(names):
        given.extend(names)
        fill(names)

    monkeypatch.setattr(own, "_fill_in", noted)
    hot = ["the", "Été,", "of...", "x"]
    for _ in range(60):
        rare = ["".join(draw.choice("abcdeñ") for _ in range(7)) + draw.choice(["", ",", ")*;"]) for _ in range(20)]
        words = hot * 8 + rare
        draw.shuffle(words)
        texts = [" ".join(words[:25]) + "\nNext", "\n".join(words[25:])]
        ids, counts = own.encode([text.encode() for text in texts])
        expected = [lib.encode(text, add_special_tokens=False).ids for text in texts]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(e) for e in expected]
        assert len(own.blocks) == own.filled <= 60 + 4 * 24
    for word in hot:
        assert given.count(word.encode()) == 1


def test_words_with_marks_and_line_starts_need_no_whole_chain(monkeypatch):
    path = tokenizer_path()
    own, lib = Encoder(path), library(path)
    texts = ["Word (a) b%%% c'' d's\nLine, é!?\nÑu'\n'x", "a", "a_b\\c^^", "\nx", "x.\n"]
    asked = []
    plain = own._library
    monkeypatch.setattr(own, "_library", lambda given: asked.extend(given) or plain(given))
    ids, counts = own.encode([text.encode() for text in texts])
    expected = [lib.encode(text, add_special_tokens=False).ids for text in texts]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(e) for e in expected]
    assert not {b"Word", b" b%%%", b" c''", b"\nLine,"} & set(asked)
