"""Every operator over tables with nulls, repeated rows and columns of clashing names."""

from __future__ import annotations

import pytest

from shelflight.llm import (
    attention_lm,
    chunk_dedup,
    decontamination,
    exact_dedup,
    mixing,
    packing,
    quality,
    simhash,
    spelling,
    token_count,
    token_files,
    url_filter,
)
from tests.llm.conftest import DDL, ODD_TEXTS, prose



def _items(documents):
    return documents.where("doc_id > 15").selectExpr("doc_id as item_id", "text", "'x' as window")


OPERATORS = {
    "quality": (quality.quality_report, 1),
    "token_count": (token_count.token_counts, 1),
    "passages": (chunk_dedup.passages, None),
    "drop_repeats": (chunk_dedup.drop_repeats, 1),
    "exact": (exact_dedup.exact_groups, 1),
    "simhash": (simhash.near_groups, 1),
    "token_files": (token_files.round_trip, 1),
    "packing": (packing.pack_documents, None),
    "scores": (lambda d: attention_lm.lm_scores(d, steps=3), 1),
    "mixing": (mixing.mix_report, 1),
    "spelling": (spelling.spelling_variants, None),
    "contamination": (lambda d: decontamination.contamination(d, _items(d)), 1),
}
EXTRA = [
    "row", "fp", "digest", "size", "key", "place", "n", "text_key", "start", "score", "rank", "chars",
    "ids", "word", "held_out", "piece", "length", "end", "first_doc_id", "copies", "last", "kept",
    "spans", "__spans", "n_hit", "items", "form", "root",
]


def rows():
    texts = [*ODD_TEXTS, *[prose(seed, 70) for seed in range(12)]]
    given = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    given += [(None, texts[-1], None, None, None), (None, None, None, None, None)]
    return given + given[5:9] + [(-7, texts[-2], None, "s", None), (2**62, "", "xx", "", 0)]


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, name):
    operator, per_row = OPERATORS[name]
    plain = spark.createDataFrame(rows(), DDL)
    extra = plain.selectExpr("*", *[f"'x' as {column}" for column in EXTRA])
    columns = [c for c in operator(plain).columns if c not in ("sequence_id", "offset")]
    expected = sorted(map(str, operator(plain).select(*columns).collect()))
    found = operator(extra)
    if name == "drop_repeats":
        assert found.columns == extra.columns
        columns = plain.columns
    assert sorted(map(str, found.select(*columns).collect())) == expected
    if per_row:
        assert len(expected) == len(rows())


def test_pages(spark):
    urls = [None, "", "http://a.com/", "http://a.com/", "x" * 100_000, "http://b.net/fr/"]
    pages = spark.createDataFrame([(i if i % 2 else None, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    extra = pages.selectExpr("*", "'x' as host", "'y' as path", "'z' as rule", "1 as verdict", "2 as score")
    plain = sorted(map(str, url_filter.judge(pages).collect()))
    assert sorted(map(str, url_filter.judge(extra).collect())) == plain
    assert len(plain) == len(urls)
