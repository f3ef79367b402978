from __future__ import annotations

import random

import numpy as np
import xxhash

from shelflight.llm import simhash
from tests.llm.conftest import ODD_TEXTS, prose


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(run), seed=42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest index reachable over 3 or fewer bits."""
    label = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def near_copies():
    draw = random.Random(3)
    texts = []
    for seed in range(12):
        words = prose(seed, 150).split()
        for _ in range(5):
            texts.append(" ".join(words))
            words[draw.randrange(len(words))] = "other"
    return texts


def test_matches_brute_force(documents_of):
    texts = [*ODD_TEXTS, *near_copies()]
    prints = [plain_print(text) for text in texts]
    expected = {
        i: (f"{p:016x}", c) for (i, p), c in zip(enumerate(prints), plain_groups(prints), strict=True)
    }
    rows = simhash.near_groups(documents_of(texts)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == expected
    assert len(rows) == len(texts)


def scattered(count, seed):
    """Values with many close ones, among them a dense ball."""
    draw = random.Random(seed)
    values = {draw.getrandbits(64) for _ in range(count)}
    for value in list(values)[: count // 3]:
        for _ in range(3):
            value ^= 1 << draw.randrange(64)
            values.add(value)
    values |= {v << 40 | 5 for v in range(200)}
    return np.array(sorted(values), np.uint64)


def test_trie_finds_every_pair():
    values = scattered(300, 1)
    found = set()
    for i, j in simhash.linked_pairs(values, np.array([0]), np.array([len(values)]), 3):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    gaps = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(gaps <= 3), strict=True) if i < j}


def test_crowded_branches_are_cut(spark):
    values = scattered(400, 2)
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    expected = plain_groups([int(v) for v in values])
    for limit in (20_000, 100, 25):
        edges = simhash.links(prints, branch_rows=limit).collect()
        place = {int(v): i for i, v in enumerate(values.view(np.int64))}
        label = np.arange(len(values))
        pairs = np.array([(place[e.u], place[e.v]) for e in edges])
        label = simhash.merge_pairs(label, pairs[:, 0], pairs[:, 1])
        assert label.tolist() == expected


def test_one_of_each_group_stays(documents_of):
    texts = [*ODD_TEXTS, *near_copies()]
    expected = sorted(set(plain_groups([plain_print(text) for text in texts])))
    left = simhash.drop_near_copies(documents_of(texts).union(documents_of(texts)))
    assert sorted(r.doc_id for r in left.collect()) == expected


def test_empty(documents_of):
    assert simhash.near_groups(documents_of([])).collect() == []
    assert simhash.drop_near_copies(documents_of([])).collect() == []
