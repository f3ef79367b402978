"""Language-model scores of texts by a small causal self-attention model.

A text is its words, A-Z lower-cased, each after a space, as ids of a byte-level
vocabulary, and one end. The model predicts a class for every token and the token within its class:

* Classes: the most frequent ids are classes of their own; the others share
  classes, by whether they start a word and by frequency. The share of an id in
  its class follows from the counts over all training texts.
* One layer of causal self-attention and one hidden layer predict the next class.
  Its weights are trained in numpy with Adam on every window of every training
  text, in ``ROUNDS`` rounds with a share of the texts each. In a round every task
  goes on from the same weights over its own windows; the weights and moments that
  the tasks end with are averaged by their windows and start the next round. Few
  windows are gone through as often as ``steps`` steps a task take, at least once.
* A text is scored in windows that overlap: each token is scored once, in the
  first window that has it, with at least ``OVERLAP`` tokens before it except at
  the start of the text. A task runs many windows at a time as masked matrices.

Beside it stands the base score, an add-0.1 unigram model over all training words.
Words with at least ``HEAD`` of all training tokens, which bounds their number,
travel with the tasks; the tail meets its counts in a join, where no word can be
hot any more.

Texts whose crc32(doc_id) mod 10 is 0 are held out of all counts and training.

Nulls: a null text counts as empty and consists of the end alone; a null doc_id
counts as an empty one for the remainder. Repeated rows are scored as often as
given. Without training texts the model is near uniform and the base score is
that of its formula at zero counts. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import lowered, ragged, settle, slices, text_bytes
from shelflight.llm.tokens import (
    LONGEST_ENTRY,
    TABLE_ENTRIES,
    Encoder,
    binary_rows,
    tokenizer_path,
)

VOCABULARY = "byte_bpe_50k.tiktoken"
CLASSES = 128
SINGLE = 95
WIDTH = 16
HIDDEN = 32
WINDOW = 32
OVERLAP = 8
ROUNDS = 8
# States of tasks that one task averages, about.
FAN_IN = 64
# Least steps of a task over all rounds, windows of a step, windows that a task shuffles at a time.
STEPS = 800
BATCH = 64
SHUFFLED = 1 << 14
RATE = 0.01
SEED = 5
HEAD = 1e-5
# Distinct words that a task counts before it hands them over; windows run at a time;
# ids that a task scores at a time.
COUNTED_WORDS = 300_000
AT_ONCE = 512
SCORED_IDS = 400_000
_U2 = np.dtype("<u2")
_U4 = np.dtype("<u4")
# White space outside ASCII, at which the library joins words to what stands beside them.
_RARE_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "subwords",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=_ranks(path),
        special_tokens={},
    )


@functools.cache
def _values(path: str) -> list[bytes]:
    values = [b""] * (max(_ranks(path).values()) + 1)
    for token, rank in _ranks(path).items():
        values[rank] = token
    return values


@functools.cache
def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids, one after the other, with each one's start and length."""
    values = _values(path)
    lengths = np.array(list(map(len, values)), np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths


@functools.cache
def starts_word(path: str) -> np.ndarray:
    """Of each id, whether it begins with the space before a word."""
    return np.array([value[:1] == b" " for value in _values(path)])


def decode(ids: np.ndarray, path: str) -> bytes:
    data, starts, lengths = id_bytes(path)
    return data[ragged(starts[ids], lengths[ids])].tobytes()


def _kind(path: str) -> np.dtype:
    return _U2 if len(id_bytes(path)[2]) <= 1 << 16 else _U4


# ---- texts as ids ----------------------------------------------------------------


def subwords(words: list[bytes], path: str) -> np.ndarray:
    text = b"".join(b" " + word for word in words).decode()
    return _encoding(path).encode_to_numpy(text, allowed_special=set(), disallowed_special=())


class WordEncoder(Encoder):
    """Ids of words by tiktoken; one per worker and vocabulary.

    The library joins a word with another only at white space outside ASCII. Words of
    other texts are encoded once each and kept in the bounded table of ``Encoder``.
    """

    def __init__(self, path: str):
        self.path = path
        self._start_anew()

    def _fill_in(self, names: list[bytes]) -> None:
        ids = subwords(names, self.path)
        begins = np.flatnonzero(starts_word(self.path)[ids])
        self._append(ids, np.diff(begins, append=len(ids)))

    def _library(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        return [subwords(words, self.path) for words in texts]

    def _stays_whole(self, words: list[bytes]) -> bool:
        if not words:
            return False
        text = b" ".join(words)
        return len(max(words, key=len)) > LONGEST_ENTRY or (
            not text.isascii() and _RARE_SPACE.search(text) is not None
        )

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all texts one after the other, and the number of ids of each text."""
        if len(self.blocks) > TABLE_ENTRIES:
            self._make_room()
        number = self.blocks.__getitem__
        parts, counts, whole = [], [], {}
        for at, words in enumerate(texts):
            if self._stays_whole(words):
                whole[at] = words
                counts.append(0)
                continue
            counts.append(len(words))
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
        ids, totals = self._looked_up(parts, counts)
        own = self._library(list(whole.values()))
        return self._merged(ids, totals, dict(zip(whole, own, strict=True)))


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    row, kind = TaskContext.get().partitionId() << 33, _kind(path)
    for batch in slices(batches, "text"):
        words = [lowered(text).split() for text in text_bytes(batch.column("text"))]
        found, counts = word_encoder(path).encode(words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + len(words))),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([len(own) for own in words], pa.int64()),
                pa.array(counts),
                binary_rows(found.astype(kind), counts),
            ],
            names=["row", "doc_id", "held_out", "n_words", "n_ids", "ids"],
        )
        row += len(words)


def _texts(batches: Iterable[pa.RecordBatch], kind: np.dtype, most: int):
    """Batches with their ids as one array and the number of each text, about ``most`` at a time."""
    for batch in batches:
        sizes = batch.column("n_ids").to_numpy()
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(to, at + 1)
            part = batch.slice(at, to - at)
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), kind).astype(np.int64)
            yield part, ids, sizes[at:to]
            at = to


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(word, null, n) of words and (null, id, n) of ids."""
    words, ids = Counter(), np.zeros(len(id_bytes(path)[2]), np.int64)

    def given() -> pa.RecordBatch:
        used = np.flatnonzero(ids)
        names = [*words, *[None] * len(used)]
        counts = np.concatenate([np.fromiter(words.values(), np.int64, len(words)), ids[used]])
        numbers = [*[None] * len(words), *used.tolist()]
        words.clear()
        ids[:] = 0
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(numbers, pa.int64()), pa.array(counts)],
            names=["word", "id", "n"],
        )

    for _, found, _ in _texts(batches, _kind(path), SCORED_IDS):
        words.update(decode(found, path).split())
        ids += np.bincount(found, minlength=len(ids))
        if len(words) > COUNTED_WORDS:
            yield given()
    yield given()


# ---- the model -------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Class of each id, and the log of its share in it; the last class is the end's."""

    of: np.ndarray
    log_share: np.ndarray
    log_class: np.ndarray

    @classmethod
    def build(cls, counts: np.ndarray, starts_word: np.ndarray, texts: int) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        of = np.empty(len(counts), np.int64)
        of[order[:SINGLE]] = np.arange(min(SINGLE, len(counts)))
        shared = CLASSES - 1 - SINGLE
        halves = [shared // 2, shared - shared // 2]
        first = SINGLE
        for starts, parts in zip((True, False), halves, strict=True):
            rest = order[SINGLE:][starts_word[order[SINGLE:]] == starts]
            # Strata of equal mass; every id has at least the mass of half a token.
            mass = np.cumsum(counts[rest] + 0.5)
            if len(rest):
                of[rest] = first + np.minimum(parts - 1, (mass * parts / (mass[-1] + 1e-9)).astype(int))
            first += parts
        smooth = counts + 0.5
        total = np.bincount(of, smooth, CLASSES)
        classes = total + 0.5
        classes[-1] = texts + 0.5
        return cls(of, np.log(smooth / total[of]), np.log(classes / classes.sum()))


def _start(log_class: np.ndarray) -> dict[str, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(SEED))

    def normal(*shape):
        return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    return {
        "E": draw.standard_normal((CLASSES + 1, WIDTH)).astype(np.float32) * 0.5,
        "P": draw.standard_normal((WINDOW, WIDTH)).astype(np.float32) * 0.1,
        **{name: normal(WIDTH, WIDTH) for name in ("Q", "K", "V", "O")},
        "A": normal(WIDTH, HIDDEN),
        "a": np.zeros(HIDDEN, np.float32),
        "B": normal(HIDDEN, WIDTH),
        "U": normal(WIDTH, CLASSES) * np.float32(0.3),
        "b": log_class.astype(np.float32),
    }


_MASK = np.where(np.tri(WINDOW, dtype=bool), 0, -np.inf).astype(np.float32)


class Kept:
    """Arrays by name that each step writes anew, so that their memory is fetched only once."""

    def __init__(self):
        self.arrays: dict[str, np.ndarray] = {}

    def __call__(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        size, own = math.prod(shape), self.arrays.get(name)
        if own is None or len(own) < size or own.dtype != dtype:
            own = self.arrays[name] = np.empty(size, dtype)
        return own[:size].reshape(shape)

    def product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b, out=self(name, a.dtype, *a.shape[:-1], b.shape[-1]))

    def chosen(self, name: str, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = self(name, rows.dtype, *places.shape, rows.shape[1])
        # With out, only a mode other than "raise" takes no copy; all places are inside.
        return rows.take(places, axis=0, out=out, mode="clip")


def _rows(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _softmax(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The maximum is taken off only where an exponential over- or underflows without."""
    ones = np.ones(x.shape[-1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(x, out=out)
        total = _rows(e) @ ones
    if not (np.isfinite(total).all() and total.min(initial=1) > 0):
        e = np.exp(x - x.max(axis=-1, keepdims=True), out=out)
        total = _rows(e) @ ones
    e /= total.reshape(*x.shape[:-1], 1)
    return e


def _forward(w: dict[str, np.ndarray], inputs: np.ndarray, kept: Kept | None = None) -> tuple:
    """Hidden states of windows of input classes, with what the gradient needs."""
    kept = kept or Kept()
    x = kept.chosen("x", w["E"], inputs)
    x += w["P"]
    q, k, v = (kept.product(f"x{name}", _rows(x), w[name]).reshape(x.shape) for name in "QKV")
    s = kept.product("s", q, k.transpose(0, 2, 1))
    s *= s.dtype.type(1 / np.sqrt(WIDTH))
    s += _MASK
    attention = _softmax(s, kept("attention", s.dtype, *s.shape))
    mixed = kept.product("mixed", attention, v)
    h = kept.product("h", _rows(mixed), w["O"]).reshape(x.shape)
    h += x
    r = kept.product("r", _rows(h), w["A"]).reshape(*x.shape[:2], HIDDEN)
    r += w["a"]
    np.maximum(r, 0, out=r)
    y = kept.product("y", _rows(r), w["B"]).reshape(x.shape)
    y += h
    return x, q, k, v, attention, mixed, h, r, y


def _gradients(w, inputs, targets, real, kept: Kept | None = None) -> dict[str, np.ndarray]:
    kept = kept or Kept()
    x, q, k, v, attention, mixed, h, r, y = _forward(w, inputs, kept)
    kind, places = x.dtype, np.flatnonzero(real)
    n = max(1, len(places))
    h, r, y = (
        kept.chosen(f"real {name}", _rows(m), places) for name, m in (("h", h), ("r", r), ("y", y))
    )
    z = kept.product("z", y, w["U"])
    z += w["b"]
    d = _softmax(z, kept("d", kind, *z.shape))
    d[np.arange(len(d)), targets.ravel()[places]] -= 1
    g = {"U": y.T @ d / n, "b": d.sum(0) / n}
    dy = kept.product("dy", d, w["U"].T)
    dy /= n
    g["B"] = r.T @ dy
    dr = kept.product("dr", dy, w["B"].T)
    dr *= r > 0
    g["A"], g["a"] = h.T @ dr, dr.sum(0)
    dy += kept.product("dr A", dr, w["A"].T)
    dh = kept("dh", kind, *x.shape)
    dh.fill(0)
    _rows(dh)[places] = dy
    g["O"] = _rows(mixed).T @ _rows(dh)
    dm = kept.product("dm", _rows(dh), w["O"].T).reshape(dh.shape)
    da = kept.product("da", dm, v.transpose(0, 2, 1))
    dv = kept.product("dv", attention.transpose(0, 2, 1), dm)
    da -= np.multiply(dm, mixed, out=kept("dm mixed", kind, *dm.shape)).sum(-1, keepdims=True)
    da *= attention
    da *= kind.type(1 / np.sqrt(WIDTH))
    dq, dk = kept.product("dq", da, k), kept.product("dk", da.transpose(0, 2, 1), q)
    dx = _rows(dh)
    for name, part in (("Q", dq), ("K", dk), ("V", dv)):
        g[name] = _rows(x).T @ _rows(part)
        dx += kept.product("dx", _rows(part), w[name].T)
    g["P"] = dh.sum(0)
    one_hot = kept("one_hot", kind, len(w["E"]), inputs.size)
    one_hot.fill(0)
    one_hot[inputs.ravel(), np.arange(inputs.size)] = 1
    g["E"] = one_hot @ dx
    return g


def _flat(parts: Iterable[dict[str, np.ndarray]], step: float) -> np.ndarray:
    values = [value.ravel() for part in parts for value in part.values()]
    return np.concatenate([*values, [step]]).astype(np.float32)


def _named(values: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the weights that stand in a row."""
    found, at = {}, 0
    for name, value in _start(np.zeros(CLASSES)).items():
        found[name] = values[at : at + value.size].reshape(value.shape)
        at += value.size
    return found


def _unflat(state: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Weights, first and second moments, each in a row, and the steps behind them."""
    return [part.copy() for part in np.split(state[:-1], 3)], float(state[-1])


def training_windows(classes: np.ndarray, sizes: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Every window of each text, ``uses`` times: the class before it, its own ones, -1 for none."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = ragged(np.zeros(len(sizes), np.int64), counts) * WINDOW
    place = (begins[owner] + first)[:, None] + np.arange(-1, WINDOW)
    rows = classes[np.clip(place, 0, max(0, len(classes) - 1))].astype(np.int16)
    rows[place >= ends[owner][:, None]] = -1
    rows[first == 0, 0] = CLASSES
    return np.repeat(rows, uses[owner], axis=0)


def _round(
    batches: Iterable[pa.RecordBatch],
    kind: np.dtype,
    of: np.ndarray,
    state: np.ndarray,
    nth: int,
    expected: float,
) -> Iterator[pa.RecordBatch]:
    """The state after a task's windows of the round, and how many those are."""
    (weights, first, second), step = _unflat(state)
    w, kept = _named(weights), Kept()
    draw = np.random.Generator(np.random.PCG64([SEED + 1, nth, TaskContext.get().partitionId()]))
    done = 0

    def go(rows: np.ndarray) -> None:
        nonlocal done, step
        step, done = step + 1, done + len(rows)
        real = rows[:, 1:] >= 0
        inputs, targets = np.maximum(rows[:, :-1], 0), np.maximum(rows[:, 1:], 0)
        past = (nth + min(1.0, done / expected)) / ROUNDS
        rate = RATE * min(1.0, step / 50, 1.2 * (1 - past) + 0.02)
        found = _gradients(w, inputs, targets, real, kept)
        g = np.concatenate([found[name].ravel() for name in w])
        first[:] += 0.1 * (g - first)
        second[:] += 0.01 * (g * g - second)
        m, s = first / (1 - 0.9**step), second / (1 - 0.99**step)
        weights[:] -= rate * m / (np.sqrt(s) + 1e-8)

    def shuffled(waiting: list[np.ndarray], whole: bool) -> list[np.ndarray]:
        """Take steps over what waits; unless it is the whole rest, the last few windows wait on."""
        rows = draw.permutation(np.concatenate(waiting))
        to = len(rows) if whole else len(rows) - len(rows) % BATCH
        for at in range(0, to, BATCH):
            go(rows[at : min(at + BATCH, to)])
        return [rows[to:]]

    waiting = [np.empty((0, WINDOW + 1), np.int16)]
    for part, ids, sizes in _texts(batches, kind, SHUFFLED * WINDOW):
        classes = np.insert(of[ids], np.cumsum(sizes), CLASSES - 1)
        waiting.append(training_windows(classes, sizes + 1, part.column("uses").to_numpy()))
        if sum(map(len, waiting)) >= SHUFFLED:
            waiting = shuffled(waiting, whole=False)
    shuffled(waiting, whole=True)
    if done:
        yield _ended(TaskContext.get().partitionId(), done, np.append(np.concatenate([weights, first, second]), step))


_ENDED = "task int, n bigint, state binary"


def _ended(task: int, n: int, state: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([task], pa.int32()), pa.array([n], pa.int64())]
    columns.append(pa.array([state.astype(np.float32).tobytes()], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["task", "n", "state"])


def _mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of states, each weighted by its windows; one of them is held at a time."""
    total, n = 0.0, 0
    for batch in batches:
        for own, state in zip(
            batch.column("n").to_pylist(), batch.column("state").to_pylist(), strict=True
        ):
            total, n = total + own * np.frombuffer(state, np.float32).astype(float), n + own
    if n:
        yield _ended(TaskContext.get().partitionId(), n, total / n)


def _averaged(ended: DataFrame) -> tuple[int, np.ndarray | None]:
    """Windows and mean state of all tasks: groups of them are averaged by tasks, until one is left."""
    ended = settle(ended, "states")
    count = ended.count()
    while count:
        count = -(-count // FAN_IN)
        group = F.expr(f"task % {count}")
        dealt = ended.repartition(count, group).sortWithinPartitions("task")
        ended = settle(dealt.mapInArrow(_mean, _ENDED), "states")
        if count == 1:
            row = ended.first()
            return row.n, np.frombuffer(row.state, np.float32)
        count = ended.count()
    return 0, None


def train(
    training: DataFrame, windows: int, tasks: int, vocabulary: Vocabulary, kind: np.dtype, steps: int
) -> tuple[dict[str, np.ndarray], int]:
    """Weights from all windows of the texts (row, n_ids, ids), and the windows gone through."""
    start = _start(vocabulary.log_class)
    zero = {name: np.zeros_like(value) for name, value in start.items()}
    state, seen = _flat((start, zero, zero), 0), 0
    if not windows:
        return start, seen
    passes = max(1, -(-steps * BATCH * tasks // windows))
    expected = windows * passes / (ROUNDS * tasks)
    place = F.pmod(F.xxhash64("row"), F.lit(ROUNDS))
    for nth in range(ROUNDS):
        # Over all rounds each text is used as often as there are passes.
        upto = [F.floor((F.lit(passes * n) + place) / ROUNDS) for n in (nth, nth + 1)]
        own = training.select("n_ids", "ids", (upto[1] - upto[0]).alias("uses")).where("uses > 0")
        make = partial(
            _round, kind=kind, of=vocabulary.of, state=state, nth=nth, expected=expected
        )
        # The driver gets one row of some 80 kB.
        n, mean = _averaged(own.mapInArrow(make, _ENDED))
        if n:
            state, seen = mean, seen + n
    return _named(_unflat(state)[0][0]), seen


# ---- scores ----------------------------------------------------------------------


def spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of ``sizes`` tokens, one after the other: each window's text and first token."""
    step = WINDOW - OVERLAP
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // step))
    nth = ragged(np.zeros(len(sizes), np.int64), counts)
    return np.repeat(np.arange(len(sizes)), counts), nth * step


_BEFORE = np.tri(WINDOW, dtype=np.float32)
_ONES = np.ones(max(CLASSES, WINDOW), np.float32)


def _log_p(
    w: dict[str, np.ndarray],
    inputs: np.ndarray,
    own: np.ndarray,
    targets: np.ndarray,
    kept: Kept,
    seen: int = 0,
):
    """Log-probabilities of the targets at the places ``own`` of windows of inputs.

    The first ``seen`` places of the windows are only looked back at. Exponentials are
    taken without subtracting their maximum first, which the weights keep far from
    overflow; should one overflow all the same, the careful way is taken.
    """
    n = len(inputs)
    x = kept.chosen("x", w["E"], inputs)
    x += w["P"]
    last = x if not seen else np.ascontiguousarray(x[:, seen:])
    q = kept.product("q", _rows(last), w["Q"]).reshape(n, -1, WIDTH)
    k, v = (kept.product(f"x{name}", _rows(x), w[name]).reshape(x.shape) for name in "KV")
    with np.errstate(over="ignore", invalid="ignore"):
        weight = kept.product("weight", q, k.transpose(0, 2, 1))
        weight *= np.float32(1 / np.sqrt(WIDTH))
        np.exp(weight, out=weight)
        weight *= _BEFORE[seen:]
        total = _rows(weight) @ _ONES[:WINDOW]
        mixed = _rows(kept.product("mixed", weight, v))
        mixed /= total[:, None]
        rows = np.flatnonzero(own[:, seen:])
        h = kept.product("h", kept.chosen("own", mixed, rows), w["O"])
        h += kept.chosen("own", _rows(last), rows)
        r = kept.product("r", h, w["A"])
        r += w["a"]
        y = kept.product("y", np.maximum(r, 0, out=r), w["B"])
        y += h
        logits = kept.product("logits", y, w["U"])
        logits += w["b"]
        found = logits[np.arange(len(targets)), targets]
        np.exp(logits, out=logits)
        log_p = found - np.log(logits @ _ONES[:CLASSES])
    if np.isfinite(log_p).all():
        return log_p
    logits = _forward(w, inputs)[-1][own] @ w["U"] + w["b"]
    logits -= logits.max(axis=1, keepdims=True)
    return logits[np.arange(len(targets)), targets] - np.log(np.exp(logits).sum(axis=1))


def score_classes(w: dict[str, np.ndarray], classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text's classes."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    before = np.concatenate([[CLASSES], classes[:-1]])
    before[begins] = CLASSES
    owner, first = spans(sizes)
    total, kept = np.zeros(len(sizes)), Kept()
    # Scored in a window: what the text still has and no earlier window had.
    for chosen, seen in ((first == 0, 0), (first > 0, OVERLAP)):
        owners, starts = owner[chosen], first[chosen]
        for at in range(0, len(owners), AT_ONCE):
            text, start = owners[at : at + AT_ONCE], starts[at : at + AT_ONCE]
            place = (begins[text] + start)[:, None] + np.arange(WINDOW)
            own = place < ends[text][:, None]
            own[:, :seen] = False
            place = np.minimum(place, ends[text][:, None] - 1)
            log_p = _log_p(w, before[place], own, classes[place[own]], kept, seen)
            total += np.bincount(np.repeat(text, own.sum(axis=1)), log_p, len(sizes))
    return total


@dataclass
class Head:
    """Log10 base probabilities of the frequent words, and whether the end is known."""

    scores: dict[bytes, float]
    end_score: float
    end_known: bool


def _scored(
    batches: Iterable[pa.RecordBatch], path: str, vocabulary: Vocabulary, weights: dict, head: Head
) -> Iterator[pa.RecordBatch]:
    for part, ids, sizes in _texts(batches, _kind(path), SCORED_IDS):
        ends = np.cumsum(sizes)
        classes = np.insert(vocabulary.of[ids], ends, CLASSES - 1)
        inside = np.concatenate([[0.0], np.cumsum(vocabulary.log_share[ids])])
        score = score_classes(weights, classes, sizes + 1) + inside[ends] - inside[ends - sizes]
        words = decode(ids, path).split()
        # Words that do not travel with the task have no score, NaN.
        given = np.array(list(map(head.scores.get, words)), float)
        frequent = ~np.isnan(given)
        n_words = part.column("n_words").to_numpy()
        text = np.repeat(np.arange(len(n_words)), n_words)
        here = text[frequent]
        base = np.bincount(here, given[frequent], len(n_words)) + head.end_score
        known = np.bincount(here, minlength=len(n_words)) + head.end_known
        rest = np.flatnonzero(~frequent)
        tails, at = [], 0
        for n in np.bincount(text[rest], minlength=len(n_words)).tolist():
            tails.append(Counter([words[place] for place in rest[at : at + n].tolist()]).items())
            at += n
        lengths = np.array([len(tail) for tail in tails], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        tail = pa.StructArray.from_arrays(
            [
                pa.array([word for found in tails for word, _ in found], pa.binary()),
                pa.array([n for found in tails for _, n in found], pa.int64()),
            ],
            names=["word", "times"],
        )
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(name) for name in ("row", "doc_id", "held_out")),
                pa.array(n_words + 1),
                pa.array(base),
                pa.array(known),
                pa.array(score / np.log(10)),
                pa.ListArray.from_arrays(offsets, tail),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "base", "known", "score", "tail"],
        )


def lm_scores(documents: DataFrame, path: str | None = None, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = path or tokenizer_path(VOCABULARY)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    read = documents.select("doc_id", "text", (F.crc32(name) % 10 == 0).alias("held_out"))
    kind = read.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, held_out boolean, n_words bigint, n_ids bigint, ids binary"
    texts = settle(read.mapInArrow(partial(_encoded, path=path), schema), "lm-ids")
    training = texts.where("not held_out")

    counted = settle(
        training.select("n_ids", "ids")
        .mapInArrow(partial(_count, path=path), "word binary, id bigint, n bigint")
        .groupBy("word", "id")
        .agg(F.sum("n").alias("n")),
        "lm-counts",
    )
    totals = counted.where("word is not null").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")
    ).first()
    windows = F.sum(F.floor(F.col("n_ids") / WINDOW) + 1).alias("windows")
    placed = training.select("n_ids", F.spark_partition_id().alias("task"))
    tasks = F.size(F.collect_set("task")).alias("tasks")
    sizes = placed.agg(F.count("*").alias("texts"), windows, tasks).first()
    tokens = (totals.n or 0) + sizes.texts
    kinds = totals.kinds + (1 if sizes.texts else 0)
    below = tokens + 0.1 * (kinds + 1)

    # At most one row per id of the vocabulary, and 1/HEAD words.
    counts = np.zeros(len(id_bytes(path)[2]), np.int64)
    for row in counted.where("id is not null").collect():
        counts[row.id] = row.n
    frequent = counted.where(F.col("word").isNotNull() & (F.col("n") >= HEAD * tokens))
    head = Head(
        {bytes(r.word): float(np.log10((r.n + 0.1) / below)) for r in frequent.collect()},
        float(np.log10((sizes.texts + 0.1) / below)),
        sizes.texts > 0,
    )
    vocabulary = Vocabulary.build(counts, starts_word(path), sizes.texts)
    weights, _ = train(
        training, sizes.windows or 0, sizes.tasks, vocabulary, _kind(path), steps
    )

    schema = (
        f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, base double, known bigint, "
        "score double, tail array<struct<word: binary, times: bigint>>"
    )
    make = partial(_scored, path=path, vocabulary=vocabulary, weights=weights, head=head)
    parts = settle(texts.mapInArrow(make, schema), "lm-parts")
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times")
    rare = counted.where(F.col("word").isNotNull() & (F.col("n") < HEAD * tokens)).select("word", "n")
    n = F.coalesce("n", F.lit(0))
    sums = (
        tail.join(rare, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(below))).alias("tail_base"),
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        )
    )
    return parts.drop("tail").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
