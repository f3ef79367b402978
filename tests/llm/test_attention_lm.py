from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from shelflight.llm import attention_lm as lm
from shelflight.llm import tokens
from shelflight.llm.tokens import tokenizer_path
from tests.llm.conftest import ODD_TEXTS, prose


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_base(texts):
    tokens = {i: [*words_of(t), "end"] for i, t in texts.items()}
    counts = Counter(t for i, own in tokens.items() if not held(i) for t in own)
    n, v = counts.total(), len(counts)
    return n, {
        i: (
            len(own),
            sum(counts[t] > 0 for t in own),
            sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own),
        )
        for i, own in tokens.items()
    }


@pytest.mark.parametrize("head", [1e-5, 0.01])
def test_base_scores(documents_of, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    texts = dict(enumerate([*ODD_TEXTS, *[prose(s, 80) for s in range(60)]]))
    total, expected = plain_base(texts)
    rows = lm.lm_scores(documents_of(list(texts.values())), steps=5).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_tokens, n_known, base = expected[row.doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n_tokens, n_known, total)
        assert row.held_out == held(row.doc_id)
        assert np.isclose(row.base_score, base)
        assert row.score < 0


def test_training_helps_held_out_texts(documents_of):
    texts = [prose(s, 60) for s in range(200)]
    scores = {
        steps: sum(r.score for r in lm.lm_scores(documents_of(texts), steps=steps).collect() if r.held_out)
        for steps in (1, 300)
    }
    assert scores[300] > 0.95 * scores[1]  # both are negative


def small_model():
    draw = np.random.default_rng(2)
    counts = draw.integers(0, 50, len(lm.id_bytes(tokenizer_path(lm.VOCABULARY))[2]))
    vocabulary = lm.Vocabulary.build(counts, np.arange(len(counts)) % 2 == 0, 10)
    return vocabulary, lm._start(vocabulary.log_class)


def test_shares_add_up():
    vocabulary, _ = small_model()
    total = np.bincount(vocabulary.of, np.exp(vocabulary.log_share), lm.CLASSES)
    assert np.allclose(total[total > 0], 1) and total[-1] == 0


def plain_score(w, classes):
    """Token by token: its window is the first that has it."""
    step, total, seen = lm.WINDOW - lm.OVERLAP, 0.0, 0
    before = [lm.CLASSES, *classes[:-1]]
    start = 0
    while seen < len(classes):
        for at in range(max(seen, start), min(start + lm.WINDOW, len(classes))):
            x = w["E"][before[start : at + 1]] + w["P"][: at + 1 - start]
            q, k, v = x[-1] @ w["Q"], x @ w["K"], x @ w["V"]
            a = np.exp(q @ k.T / 4)
            h = x[-1] + (a / a.sum()) @ v @ w["O"]
            y = h + np.maximum(h @ w["A"] + w["a"], 0) @ w["B"]
            z = y @ w["U"] + w["b"]
            total += z[classes[at]] - np.log(np.exp(z).sum())
        seen, start = min(start + lm.WINDOW, len(classes)), start + step
    return total


def test_windows_score_each_token_once():
    _, w = small_model()
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, lm.CLASSES, n) for n in (1, 5, 31, 32, 33, 56, 57, 200)]
    found = lm.score_classes(w, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(found, [plain_score(w, t.tolist()) for t in texts], rtol=1e-4)


def test_overflow_takes_the_careful_way():
    _, w = small_model()
    w["Q"] = w["Q"] * np.float32(3e3)
    w["U"] = w["U"] * np.float32(1e3)
    found = lm.score_classes(w, np.arange(40) % lm.CLASSES, np.array([40]))
    assert np.isfinite(found).all()


def test_words_come_back_from_ids():
    path = tokenizer_path(lm.VOCABULARY)
    for text in [*ODD_TEXTS, "a\u00a0b \x1cc\x85 \u3000", "<|endoftext|> x"]:
        words = words_of(text)
        assert lm.decode(lm.subwords(words, path), path).split() == words


def test_words_encoded_once_have_the_ids_of_whole_texts(monkeypatch):
    path = tokenizer_path(lm.VOCABULARY)
    spaced = [f"x{c} {c}y {c} z{c}w" for c in "\x1c\x85\u00a0\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u3000\ufeff"]
    marks = ["can't 's ' s 'S", "a" * 60 + " b", "\u2019s \u2014 \u201cq\u201d 1,000 x\u0301"]
    texts = [*ODD_TEXTS, *spaced, *marks, *[prose(s, 60) for s in range(20)], None]
    words = [words_of(text) for text in texts]
    expected = [lm.subwords(own, path).tolist() for own in words]
    encoder = lm.WordEncoder(path)
    for entries in (10**6, 10):
        # With ten entries the table is emptied by half again and again.
        monkeypatch.setattr(lm, "TABLE_ENTRIES", entries)
        monkeypatch.setattr(tokens, "TABLE_ENTRIES", entries)
        for _ in range(3):
            ids, counts = encoder.encode(words)
            found = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
            assert found == expected


def test_steps_do_not_depend_on_those_before():
    vocabulary, w = small_model()
    draw = np.random.default_rng(8)
    kept = lm.Kept()
    for n in (5, 2, 9, 1):
        rows = draw.integers(0, lm.CLASSES, (n, lm.WINDOW + 1))
        real = draw.random((n, lm.WINDOW)) < 0.7
        first = lm._gradients(w, rows[:, :-1], rows[:, 1:], real, kept)
        alone = lm._gradients(w, rows[:, :-1], rows[:, 1:], real)
        assert all(np.array_equal(first[name], alone[name]) for name in w)


def test_gradients():
    _, w = small_model()
    w = {name: value.astype(np.float64) for name, value in w.items()}
    draw = np.random.default_rng(4)
    rows = draw.integers(0, lm.CLASSES, (2, lm.WINDOW + 1))
    real = np.ones((2, lm.WINDOW), bool)
    real[1, 20:] = False

    def loss():
        z = lm._forward(w, rows[:, :-1])[-1] @ w["U"] + w["b"]
        log_p = z - np.log(np.exp(z).sum(-1, keepdims=True))
        return -(np.take_along_axis(log_p, rows[:, 1:, None], 2)[..., 0] * real).sum() / real.sum()

    gradients = lm._gradients(w, rows[:, :-1], rows[:, 1:], real)
    for name, value in w.items():
        place = tuple(draw.integers(0, n) for n in value.shape)
        if name == "E":
            place = (rows[0, 3], place[1])
        kept = value[place]
        value[place] = kept + 1e-4
        up = loss()
        value[place] = kept - 1e-4
        down = loss()
        value[place] = kept
        assert np.isclose(gradients[name][place], (up - down) / 2e-4, rtol=1e-2, atol=1e-5), name


def test_training_goes_through_every_window(spark):
    vocabulary, _ = small_model()
    draw = np.random.default_rng(6)
    kind = lm._kind(tokenizer_path(lm.VOCABULARY))
    sizes = [0, 31, 32, 33, *draw.integers(0, 30_000, 60).tolist()]
    rows = [(i, n, draw.integers(0, 50_000, n).astype(kind).tobytes()) for i, n in enumerate(sizes)]
    training = spark.createDataFrame(rows, "row bigint, n_ids bigint, ids binary")
    windows = sum(n // lm.WINDOW + 1 for n in sizes)
    assert windows > 20_000
    # Once where there are enough of them for the steps, else in whole passes.
    assert lm.train(training, windows, 8, vocabulary, kind, steps=1)[1] == windows
    few = training.where("row < 5")
    windows = sum(n // lm.WINDOW + 1 for n in sizes[:5])
    found = lm.train(few, windows, 8, vocabulary, kind, steps=10)[1]
    assert found == windows * -(-10 * lm.BATCH * 8 // windows)


def test_training_windows_have_every_token_once():
    draw = np.random.default_rng(7)
    texts = [draw.integers(0, lm.CLASSES, n) for n in (1, 31, 32, 33, 64, 100)]
    expected = []
    for text in texts:
        line = [lm.CLASSES, *text.tolist()]
        for at in range(0, len(text), lm.WINDOW):
            own = line[at : at + lm.WINDOW + 1]
            expected.append(own + [-1] * (lm.WINDOW + 1 - len(own)))
    sizes = np.array([len(t) for t in texts])
    found = lm.training_windows(np.concatenate(texts), sizes, np.ones(len(texts), np.int64))
    assert found.tolist() == expected
    twice = lm.training_windows(np.concatenate(texts), sizes, np.array([2, 0, 0, 0, 0, 0]))
    assert twice.tolist() == expected[:1] * 2


def test_empty(documents_of):
    assert lm.lm_scores(documents_of([]), steps=2).collect() == []


@pytest.mark.parametrize("fan_in", [64, 3])
def test_states_are_averaged_in_rounds(spark, monkeypatch, fan_in):
    monkeypatch.setattr(lm, "FAN_IN", fan_in)
    draw = np.random.default_rng(3)
    states, ns = draw.normal(size=(20, 5)).astype(np.float32), draw.integers(1, 9, 20)
    rows = [(t, int(n), s.tobytes()) for t, (n, s) in enumerate(zip(ns, states))]
    n, mean = lm._averaged(spark.createDataFrame(rows, lm._ENDED).repartition(6))
    assert n == ns.sum()
    assert np.allclose(mean, (states * ns[:, None]).sum(axis=0) / ns.sum(), atol=1e-6)
    assert lm._averaged(spark.createDataFrame([], lm._ENDED)) == (0, None)
