from __future__ import annotations

import random
from collections import defaultdict

from shelflight.llm import chunk_dedup as cd
from tests.llm.conftest import ODD_TEXTS, prose


def plain_ends(text: bytes):
    """One byte after the other."""
    value, hashes = 0, []
    for byte in text:
        value = ((value << 1) + int(cd._GEAR[byte])) & 0xFFFF
        hashes.append(value)
    allowed = [i for i in range(1, len(text)) if text[i] & 0xC0 != 0x80]
    ends = {i for i in allowed if hashes[i - 1] >> (16 - cd.MASK_BITS) == 0}
    ends |= {len(text)} if text else set()
    work = list(zip([0, *sorted(ends)], sorted(ends), strict=False))
    while work:
        a, b = work.pop()
        if b - a > cd.LONGEST:
            inside = [i for i in allowed if a < i < b]
            lowest = min(hashes[i - 1] for i in inside)
            cuts = [a]
            for i in inside:
                if hashes[i - 1] == lowest and (cuts == [a] or i - cuts[-1] >= cd.APART):
                    cuts.append(i)
            ends |= set(cuts[1:])
            work += list(zip(cuts, [*cuts[1:], b], strict=True))
    return sorted(ends)


TEXTS = [(t or "").encode() for t in ODD_TEXTS] + [prose(s, 200).encode() for s in range(20)]
TEXTS += ["日本語テキスト".encode() * 200, ("é" * 2000).encode()]


def test_ends_match_the_plain_hash():
    assert [e.tolist() for e in cd.chunk_ends(TEXTS)] == [plain_ends(t) for t in TEXTS]


def test_ends_do_not_depend_on_neighbours():
    alone = [cd.chunk_ends([t])[0].tolist() for t in TEXTS]
    assert [e.tolist() for e in cd.chunk_ends(TEXTS[::-1])] == alone[::-1]


def test_repeated_words_are_cut_alike():
    one, other = b"some words before " + b"Again, " * 90, b"else " + b"Again, " * 200 + b"and more"
    cut = []
    for text in (one, other):
        ends = cd.chunk_ends([text])[0].tolist()
        cut.append([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    shared = sum(len(c) for c in cut[0] if c in cut[1])
    assert shared > 450


def test_insertion_keeps_later_chunks():
    text = prose(1, 400).encode()
    moved = b"inserted " + text
    old = {text[a:b] for a, b in zip([0, *plain_ends(text)], plain_ends(text), strict=False)}
    ends = cd.chunk_ends([moved])[0].tolist()
    new = {moved[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert len(old - new) <= 3


def plain_passages(docs, least):
    seen, cut = defaultdict(set), {}
    for doc_id, text in docs.items():
        data = (text or "").encode()
        ends = plain_ends(data)
        cut[doc_id] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for _, _, chunk in cut[doc_id]:
            seen[chunk].add(doc_id)
    found = set()
    for doc_id, own in cut.items():
        runs = []
        for a, b, chunk in own:
            if len(seen[chunk]) > 1:
                if not runs or runs[-1][-1][1] != a:
                    runs.append([])
                runs[-1].append((a, b, min(seen[chunk])))
        for run in runs:
            if run[-1][1] - run[0][0] >= least:
                first = min(x[2] for x in run)
                again = sum(b - a for a, b, f in run if f < doc_id)
                found.add((doc_id, run[0][0], run[-1][1], len(run), first, again, again < least))
    return found


def planted():
    draw = random.Random(8)
    shared = [prose(1000 + i, 55) for i in range(4)]
    docs = {i: prose(i, 150) for i in range(60)}
    marked = set()
    for i in range(0, 60, 3):
        words = docs[i].split()
        at = draw.randrange(len(words))
        docs[i] = " ".join([*words[:at], shared[i // 3 % 4], *words[at:]])
        marked.add(i)
    return docs, marked


def test_passages_match_brute_force(documents_of):
    docs, _ = planted()
    docs |= {100 + i: t for i, t in enumerate(ODD_TEXTS)}
    table = documents_of(list(docs.values()))
    ids = dict(enumerate(docs))
    back = {v: k for k, v in ids.items()}
    expected = plain_passages({back[k]: v for k, v in docs.items()}, cd.LEAST)
    names = ["doc_id", "start", "end", "n_chunks", "first_doc_id", "repeated_bytes", "kept"]
    rows = {tuple(r[n] for n in names) for r in cd.passages(table).collect()}
    assert rows == expected and rows
    again = {tuple(r[n] for n in names) for r in cd.passages(table.union(table)).collect()}
    assert again == expected


def test_planted_passages_are_found_and_clean_documents_left(documents_of):
    docs, marked = planted()
    table = documents_of(list(docs.values()))
    assert {r.doc_id for r in cd.passages(table).collect()} == marked
    left = {r.doc_id: r.text for r in cd.drop_repeats(table).collect()}
    changed = {i for i, text in docs.items() if left[i] != text}
    assert changed < marked and len(changed) == len(marked) - 4
    assert all(len(left[i]) < len(docs[i]) - cd.LEAST + 1 for i in changed)


def test_passages_with_few_whole_chunks_are_extended(documents_of):
    """Shared passages of about 150 to 200 bytes, most of which lies in chunks cut by their ends."""
    draw, docs, spans, inner, seen = random.Random(5), [], [], [], defaultdict(set)
    for i in range(150):
        shared = " é" + prose(9_000 + i, draw.randrange(16, 21)) + "é "
        for seed in (2 * i, 2 * i + 1):
            before, after = prose(20_000 + seed, 30), prose(40_000 + seed, 30)
            docs.append(before + shared + after)
            spans.append((len(before), len(before) + len(shared.encode())))
        cut = []
        for text, (a, b) in zip(docs[-2:], spans[-2:], strict=True):
            ends = plain_ends(data := text.encode())
            inside = [(x, y) for x, y in zip([0, *ends], ends, strict=False) if a <= x and y <= b]
            cut.append({data[x:y] for x, y in inside})
            for x, y in zip([0, *ends], ends, strict=False):
                seen[data[x:y]].add(i)
        inner.append(cut[0] & cut[1])
    table = documents_of(docs)
    rows = {r.doc_id: r for r in cd.passages(table).collect()}
    missed = {doc_id // 2 for doc_id in set(range(len(docs))) - set(rows)}
    # A chunk that only the two documents have is enough, however short.
    sure = {i for i, own in enumerate(inner) if any(seen[c] == {i} for c in own)}
    few = {i for i in sure if sum(map(len, inner[i])) < cd.LEAST}
    assert len(few) > 40 and not missed & sure
    for doc_id, row in rows.items():
        a, b = spans[doc_id]
        # Neighbouring texts may go on alike for a few letters.
        assert a - 8 <= row.start and row.end <= b + 8 and row.end - row.start >= cd.LEAST
        assert row.kept == (doc_id % 2 == 0)
    left = {r.doc_id: r.text for r in cd.drop_repeats(table).collect()}
    assert {i for i, t in enumerate(docs) if left[i] != t} == {i for i in rows if i % 2}


def test_empty(documents_of):
    assert cd.passages(documents_of([])).collect() == []
    assert cd.drop_repeats(documents_of([])).collect() == []
