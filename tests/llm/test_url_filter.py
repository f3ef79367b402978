from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from shelflight.llm import url_filter as uf

DDL = "page_id bigint, url string, html string"
URLS = [
    None, "", "no scheme", "http://", "https://a.com", "https://a.com/", "HTTP://A.B.COM/X?q#f",
    "http://example.com/en/x", "http://m.example.com/en/", "http://www.example.com/en/1",
    "http://sub.www.example.com/en/1", "http://a.net/es/1", "http://a.net/fr/1", "http://a.net/es",
    "http://notcom/", "http://a.org?u=http://b.com/", "http://É.COM/é", "x://y://z.com/",
    "http://a.com#/b", "http://examplE.com/EN/", "http://a.\nb.com/p\nq?r",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, after = rest[:end], rest[end:]
    path = after[: min([after.index(c) for c in "?#" if c in after] or [len(after)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return host, path, best


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], DDL)


def test_parts_and_rules(spark):
    rows = uf.judge(pages(spark, URLS)).collect()
    assert len(rows) == len(URLS)
    for row in rows:
        host, path, best = plain(URLS[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, best and best[0])
        assert row.verdict == (best[1] if best else row.verdict) and row.verdict in ("allow", "block")


def test_no_model_allows(spark):
    rows = uf.judge(pages(spark, ["http://a.org/", None, "http://b.com/"])).collect()
    assert {r.verdict for r in rows} == {"allow"}
    assert uf.judge(pages(spark, [])).collect() == []


def plain_p(texts, order, seen, context, byte):
    """The smoothed probability by its definition, counted anew."""
    lines = [b"\x02" * order + t + b"\x03" for t in texts]
    p = 1 / 256
    for width in range(order + 1):
        end = context[len(context) - width :]
        after = [
            line[at]
            for line in lines
            for at in range(order, len(line))
            if line[at - width : at] == end
        ]
        if width and len(after) < seen:
            break
        p = (after.count(byte) + len(set(after)) * p) / (len(after) + len(set(after)))
    return p


def test_smoothing_is_that_of_its_definition():
    texts = [b"abcab", b"abcd", b"abca", b"xyz", b"aab"]
    model = uf.Markov(texts, order=3, seen=2)
    for context in (b"abc", b"zab", b"xxx", b"\x02\x02\x02", b"bca"):
        for byte in b"abcdxyz\x03q":
            assert math.isclose(model.log_p(context, byte), math.log(plain_p(texts, 3, 2, context, byte)))
        total = sum(math.exp(model.log_p(context, byte)) for byte in range(256))
        assert math.isclose(total, 1.0)


def test_models_tell_kinds_apart(spark):
    draw = random.Random(1)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(8))
    urls = [f"http://{word('abcde')}.com/{word('abcde')}" for _ in range(300)]
    urls += [f"http://{word('vwxyz')}.net/es/{word('vwxyz')}" for _ in range(300)]
    good = [f"http://{word('abcde')}.org/{word('abcde')}" for _ in range(100)]
    bad = [f"http://{word('vwxyz')}.org/es/{word('vwxyz')}" for _ in range(100)]
    rows = uf.judge(pages(spark, urls + good + bad)).collect()
    found = {r.page_id: r.verdict for r in rows}
    assert sum(found[600 + i] == "allow" for i in range(100)) >= 95
    assert sum(found[700 + i] == "block" for i in range(100)) >= 95


@pytest.mark.parametrize("sample", [10, 50])
def test_sample_is_bounded(spark, sample):
    urls = [f"http://a{i}.com/" for i in range(400)] + [f"http://a{i}.net/es/" for i in range(400)]
    assert uf.judge(pages(spark, urls), sample=sample).count() == 800


def test_copies_of_a_url_neither_fill_nor_empty_the_sample(spark, monkeypatch):
    """Wherever the hash puts the URL that most rows have, the others are drawn."""
    seen = []
    first = uf.Ratio.__init__

    def kept(self, accepted, rejected):
        seen.append((accepted, rejected))
        first(self, accepted, rejected)

    monkeypatch.setattr(uf.Ratio, "__init__", kept)
    draw = random.Random(4)
    others = [f"http://{draw.randrange(10**9)}.com/{i}" for i in range(400)]
    blocked = [f"http://{draw.randrange(10**9)}.net/es/{i}" for i in range(400)]
    for hot in range(3):
        urls = [*others, *blocked, *[f"http://hot{hot}.com/"] * 4_000]
        assert uf.judge(pages(spark, urls), sample=200).count() == len(urls)
        for texts in seen[-1]:
            assert 100 <= len(texts) <= 250  # four fifths of about 200
    single = ["http://a.com/x"] * 5 + ["http://a.net/es/"] * 5 + ["http://b.org/"]
    assert uf.judge(pages(spark, single)).count() == len(single)
    assert [list(t.values()) for t in seen[-1]] == [[5], [5]]


def test_models_of_all_urls_are_those_of_their_definition(spark):
    """Scores by every ruled URL, repeated rows weighing as often as they are given."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randrange(1, 6)))
    good = [f"http://{word()}.com/{word()}" for _ in range(60)]
    bad = [f"HTTP://{word()}.net/es/{word()}" for _ in range(60)]
    rest = [f"http://{word()}.org/{word()}" for _ in range(20)] + ["http://x\U0001f600.org"]
    urls = good + bad + rest + good[:5] * 3 + rest[:2] + [None, "", "http://", "no scheme"]
    found = uf.judge(pages(spark, urls), sample=None).collect()
    assert len(found) == len(urls)
    weights = [Counter(), Counter()]
    for url in good + good[:5] * 3:
        weights[0][uf._plain(url)] += 1
    for url in bad:
        weights[1][uf._plain(url)] += 1
    ratio = uf.Ratio(*map(dict, weights))
    for row in found:
        text = uf._plain(urls[row.page_id])
        if row.rule is not None or not text:
            assert row.score is None
        else:
            assert math.isclose(row.score, ratio.score(text), abs_tol=1e-8)
    assert {r.verdict for r in found if not uf._plain(urls[r.page_id])} == {"allow"}


def test_every_ruled_url_teaches(spark, monkeypatch):
    """No bound on the URLs that are learnt from: the query's call draws no sample."""
    monkeypatch.setattr(uf, "fit", None)
    draw = random.Random(1)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(8))
    urls = [f"http://{word('abcde')}.com/{word('abcde')}" for _ in range(300)]
    urls += [f"http://{word('vwxyz')}.net/es/{word('vwxyz')}" for _ in range(300)]
    good = [f"http://{word('abcde')}.org/{word('abcde')}" for _ in range(100)]
    bad = [f"http://{word('vwxyz')}.org/es/{word('vwxyz')}" for _ in range(100)]
    rows = uf.judge(pages(spark, urls + good + bad), sample=None).collect()
    found = {r.page_id: r.verdict for r in rows}
    assert sum(found[600 + i] == "allow" for i in range(100)) >= 95
    assert sum(found[700 + i] == "block" for i in range(100)) >= 95


@pytest.mark.parametrize("urls", [[], ["http://a.org/", None], ["http://a.com/"] * 3])
def test_all_urls_without_both_verdicts_allow(spark, urls):
    rows = uf.judge(pages(spark, urls), sample=None).collect()
    assert len(rows) == len(urls) and {r.verdict for r in rows} <= {"allow"}
    assert all(r.score is None for r in rows)


def test_threshold_of_all_is_the_best_cut(spark):
    draw = random.Random(3)
    given = [(round(draw.gauss(k == "allow", 1), 2), k, draw.randrange(1, 4)) for k in ("allow", "block") * 80]
    cut = uf._threshold(spark.createDataFrame(given, "score double, verdict string, n bigint"))

    def wrong(at):
        total = {k: sum(n for _, v, n in given if v == k) for k in ("allow", "block")}
        lost = sum(n for s, v, n in given if v == "allow" and s < at) / total["allow"]
        return lost + sum(n for s, v, n in given if v == "block" and s >= at) / total["block"]

    scores = sorted({s for s, _, _ in given})
    best = min(wrong(at) for at in [scores[0] - 1, *[s + 1e-4 for s in scores]])
    assert math.isclose(wrong(cut), best)


def test_one_url_of_each_verdict_is_enough(spark):
    single = ["http://a.com/x"] * 5 + ["http://a.net/es/"] * 5 + ["http://b.com.org/x", "http://b.org/es/"]
    rows = {r.page_id: r for r in uf.judge(pages(spark, single), sample=None).collect()}
    assert len(rows) == 12 and rows[10].verdict == "allow" and rows[11].verdict == "block"
