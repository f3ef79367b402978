from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import ODD_TEXTS, prose
from tests.llm.test_packing import plain_pieces
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import near_copies, plain_groups, plain_print

SYMBOLS = [" ".join(w + "###" for w in prose(s, 120).split()) for s in (900, 901)]


def table():
    good = [prose(s, 60 + s) for s in range(40)]
    texts = [*ODD_TEXTS, *good, *near_copies(), *SYMBOLS, *good[:7], " ".join(good[3].split(" ")) + " \n"]
    return [(text, f"src{i % 4}" if i % 9 else None) for i, text in enumerate(texts)]


def plain_mix(docs):
    """(doc_id, text, source) rows to copies per doc_id."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    totals = Counter()
    for i, _, source in docs:
        totals[source] += size[i]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[at % 3] for at, s in enumerate(names)}
    wanted, level = 1.5 * sum(totals.values()), 0.0
    while True:
        held = [s for s in names if 2 * totals[s] <= weight[s] * level]
        free = sum(weight[s] for s in names if s not in held)
        risen = (wanted - sum(2 * totals[s] for s in held)) / free if free else level
        if risen <= level:
            break
        level = risen
    copies = {}
    for s in names:
        target = min(2 * totals[s], round(weight[s] * level, 6))
        epochs = int(target // totals[s]) if totals[s] else 0
        rest, upto = target - epochs * totals[s], 0
        order = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, _, x in docs if x == s)
        for _, i in order:
            upto += size[i]
            copies[i] = epochs + (rest > 0 and upto - size[i] / 2 <= rest)
    return copies


def test_matches_brute_force(spark, documents_of, tmp_path):
    given = table()
    documents_of(given).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [(i, t, s) for i, (t, s) in enumerate(given) if not plain_counts(t)["base_failed"]]
    docs = [d for d in docs if d[1] not in SYMBOLS]  # what diverges here
    best = {}
    for i, text, source in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[key] = min(best.get(key, (0, 0, "", "")), (-len(text), i, text, source))
    docs = [(i, text, source) for _, i, text, source in sorted(best.values(), key=lambda b: b[1])]
    groups = plain_groups([plain_print(text) for _, text, _ in docs])
    docs = [docs[at] for at in sorted(set(groups))]
    copies = plain_mix(docs)
    assert 0 in copies.values() and 2 in copies.values()

    pieces = defaultdict(Counter)
    for r in rows:
        pieces[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
    for i, text, _ in docs:
        own = plain_pieces([text])
        expected = {(p, *rest): copies[i] for (_, p), rest in own.items() if copies[i]}
        assert pieces[i] == expected
    assert set(pieces) <= {i for i, _, _ in docs}


def test_stages_keep_columns(spark, documents_of):
    docs = documents_of(table())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema == docs.schema


def test_stages_keep_extra_and_clashing_columns(spark, documents_of):
    docs = documents_of(table()).selectExpr(
        "*", "1 as copies", "'x' as size", "2 as kept", "doc_id as keep_id", "3 as fp", "4 as place",
        "5 as target", "6 as text_key", "7 as component_id", "8 as text_sha256", "9 as key", "10 as n",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema == docs.schema
        assert {tuple(r[5:8]) for r in out.collect()} == {(1, "x", 2)}


def test_stages_keep_columns_named_like_helpers(spark, documents_of):
    names = ["__key", "__verdict", "__id", "__text", "row", "key", "id", "v", "of_id", "of_key"]
    docs = documents_of(table()).selectExpr("*", *[f"{i} as {name}" for i, name in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema == docs.schema
        assert {tuple(r[5:]) for r in out.collect()} == {tuple(range(len(names)))}


@pytest.mark.parametrize("at", range(5))
def test_stages_take_empty_tables_and_nulls(spark, documents_of, at):
    stage = corpus_pipeline.STAGES[at][1]
    assert stage(spark, documents_of([]), "").collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, documents_of([]).schema)
    assert len(stage(spark, nulls, "").collect()) == {0: 0, 1: 1, 2: 1, 3: 0, 4: 3}[at]
