"""URL filter: rules by host and path, and a ratio of character language models.

A rule names a host and the start of a path; it fits its host and all subdomains,
and the longest that fits decides. A URL without a rule is judged by two smoothed
variable-order Markov models over its bytes, one of accepted and one of rejected
URLs: the difference of its log-likelihoods, per byte, is held against a threshold.

The models learn from URLs that rules decide: from all of them, each different one
weighing as many rows as have it. Spark counts what follows every context of up to
``ORDER`` bytes, and each order's probabilities come from a join with those of the
order below, so neither counts nor models are held in one place. Counts are kept for
all URLs and for those outside each of ``HELD`` hash-drawn parts. The threshold is
calibrated on all of the same URLs, each scored by the models without its part: it is
the one at which the share of wrong verdicts, averaged over both kinds, is smallest.
Log-likelihoods are added as whole numbers (2^-32), so no order of rows moves a score.
A context is used at the longest order at which it was seen often enough; lower orders
smooth it by the number of different bytes that followed it.

``sample`` asks for small models instead, that travel with the tasks: fitted on at most
about so many different URLs of each verdict, chosen by hash, with every fifth of
them for the threshold.

Nulls: a null URL, or one without "://", has an empty host and path, fits no rule
and is judged by its text; an empty text says nothing against the URL and is
allowed. Without URLs of both verdicts there is no model, and what no rule decides
is allowed. Repeated rows come out as often as they are given; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import settle

# (verdict, host, start of the path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ALLOW, BLOCK = "allow", "block"
SAMPLE = 20_000
ORDER = 5
# A context is used if it was seen this often.
SEEN = 3
# Every fifth sampled URL calibrates the threshold; with all URLs, as many parts take turns.
HELD = 5
# Log-likelihoods as whole numbers; ranges of scores that are summed on their own.
_UNIT = float(1 << 32)
_RANGES = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = b"\x02", b"\x03"
# Remembered steps of a worker.
_STEPS = 1 << 18


# ---- parts and rules -------------------------------------------------------------


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and the rest of the URL from its host on."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    pages = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    pages = pages.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    after = F.substring("__rest", F.length("__host") + 1, F.length("__rest"))
    return pages.withColumns(
        {
            "host": F.translate("__host", _UPPER, _LOWER),
            "path": F.regexp_extract(after, "^[^?#]*", 0),
        }
    ).drop("__host", "__rest")


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add the longest rule that fits host and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, action).otherwise(verdict)
    return pages.withColumns({"rule": rule, "verdict": verdict})


# ---- models ----------------------------------------------------------------------


def _plain(url: str | None) -> bytes:
    """What is judged: the URL from its host on, lower-cased."""
    text = (url or "").encode()
    return text.partition(b"://")[2].lower() if b"://" in text else text.lower()


class Markov:
    """Byte model of variable order with Witten-Bell smoothing."""

    def __init__(
        self,
        texts: Sequence[bytes],
        order: int = ORDER,
        seen: int = SEEN,
        weights: Sequence[int] | None = None,
    ):
        counts: dict[bytes, dict[int, int]] = {}
        for text, n in zip(texts, weights or [1] * len(texts), strict=True):
            line = _START * order + text + _END
            for at in range(order, len(line)):
                for width in range(order + 1):
                    after = counts.setdefault(line[at - width : at], {})
                    after[line[at]] = after.get(line[at], 0) + n
        self.order = order
        self.after = {
            context: (sum(after.values()), after)
            for context, after in counts.items()
            if not context or sum(after.values()) >= seen
        }

    def log_p(self, context: bytes, byte: int) -> float:
        p = 1 / 256
        for width in range(self.order + 1):
            known = self.after.get(context[len(context) - width :])
            if known is None:
                break  # a longer context was not seen either
            total, after = known
            kinds = len(after)
            p = (after.get(byte, 0) + kinds * p) / (total + kinds)
        return math.log(p)


class Ratio:
    """Log-likelihood difference per byte, and the threshold it is held against."""

    def __init__(self, accepted: dict[bytes, int], rejected: dict[bytes, int]):
        """Texts with their weights."""
        self.models = tuple(
            Markov(list(texts), weights=list(texts.values())) for texts in (accepted, rejected)
        )
        self.threshold = 0.0

    @functools.cached_property
    def _step(self):
        accepted, rejected = self.models

        @functools.lru_cache(_STEPS)
        def step(window: bytes) -> float:
            return accepted.log_p(window[:-1], window[-1]) - rejected.log_p(window[:-1], window[-1])

        return step

    def __getstate__(self):
        return {"models": self.models, "threshold": self.threshold}

    def score(self, text: bytes) -> float:
        order = self.models[0].order
        line = _START * order + text + _END
        steps = (self._step(line[at - order : at + 1]) for at in range(order, len(line)))
        return sum(steps) / (len(text) + 1)

    def calibrate(self, accepted: dict[bytes, int], rejected: dict[bytes, int]) -> None:
        """The threshold with the fewest wrong verdicts, both kinds weighing the same."""
        if not accepted or not rejected:
            return

        def scored(texts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
            scores = np.array([self.score(text) for text in texts])
            order = np.argsort(scores, kind="stable")
            below = np.cumsum(np.array(list(texts.values()), float)[order])
            return scores[order], np.concatenate([[0.0], below / below[-1]])

        (good, good_below), (bad, bad_below) = scored(accepted), scored(rejected)
        every = np.unique(np.concatenate([good, bad]))
        cuts = np.concatenate([every[:1] - 1, (every[1:] + every[:-1]) / 2, every[-1:] + 1])
        lost = good_below[np.searchsorted(good, cuts)]
        passed = 1 - bad_below[np.searchsorted(bad, cuts)]
        wrong = lost + passed
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        self.threshold = float(cuts[best[len(best) // 2]])


def fit(ruled: DataFrame, sample: int = SAMPLE) -> Ratio | None:
    """Models from a bounded sample of the URLs that a rule decides."""
    # A URL's copies are one row here, so the sample is as large as it should be.
    urls = settle(ruled.groupBy("url", "verdict").count(), "ruled-urls")
    counts = {r.verdict: r["count"] for r in urls.groupBy("verdict").count().collect()}
    if not counts.get(ALLOW) or not counts.get(BLOCK):
        return None
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 20))
    share = F.lit(0)
    for name in (ALLOW, BLOCK):
        most = math.ceil(min(1.0, sample / counts[name]) * (1 << 20))
        share = F.when(F.col("verdict") == name, F.lit(most)).otherwise(share)
    rows = urls.where(draw < share).collect()
    train, held = [], []
    for name in (ALLOW, BLOCK):
        found = Counter()
        for row in rows:
            if row.verdict == name:
                found[_plain(row.url)] += row["count"]
        texts = sorted(found.items())
        # A single URL trains as well.
        train.append(dict([item for i, item in enumerate(texts) if i % HELD] or texts))
        held.append(dict(texts[::HELD]))
    ratio = Ratio(*train)
    ratio.calibrate(*held)
    return ratio


def _scores(ratio: Ratio) -> Column:
    def scored(urls: pa.Array) -> pa.Array:
        texts = (_plain(url) for url in urls.to_pylist())
        return pa.array([ratio.score(t) if t else None for t in texts], pa.float64())

    return F.arrow_udf(scored, "double")("url")


# ---- models of all URLs ----------------------------------------------------------


def _plain_text(url: str = "url") -> Column:
    """As ``_plain``."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.col(url))
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def _windows(texts: DataFrame, *columns: str) -> DataFrame:
    """Every byte of the texts and their end, after the ``ORDER`` bytes before it."""
    line = F.concat(F.lit(_START * ORDER), F.col("plain").cast("binary"), F.lit(_END))
    each = f"transform(sequence(1, octet_length(plain) + 1), i -> substring(line, i, {ORDER + 1}))"
    return texts.withColumn("line", line).select(*columns, F.explode(F.expr(each)).alias("window"))


# Counts and probabilities of both kinds: without each part, then of all.
_PLACES = [f"{kind}{part}" for part in range(HELD + 1) for kind in (ALLOW, BLOCK)]


def _counted(texts: DataFrame) -> DataFrame:
    """How often each window occurs; those of URLs without a rule only with zeros."""
    def n(place: str) -> Column:
        own = (F.col("verdict") == place[:-1]) & (F.col("part") != int(place[-1]))
        return F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(place)

    found = _windows(texts, "verdict", "part", "n").groupBy("window")
    return settle(found.agg(*map(n, _PLACES)), "url-windows")


def _steps(counted: DataFrame) -> DataFrame:
    """(window, steps): the log-likelihood ratio of the last byte, by the models of each part."""
    below = None
    for width in range(ORDER + 1):
        gram = F.substring("window", ORDER + 1 - width, width + 1).alias("gram")
        grams = counted.groupBy(gram).agg(*[F.sum(c).alias(c) for c in _PLACES])
        # At most 257 rows share a context.
        context = Window.partitionBy(F.substring("gram", 1, width))
        grams = grams.select(
            "gram",
            F.substring("gram", 2, width).alias("suffix"),
            *_PLACES,
            *[F.sum(c).over(context).alias(f"{c}_all") for c in _PLACES],
            *[F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"{c}_kinds") for c in _PLACES],
        )
        if below is None:
            joined = grams.withColumns({f"{c}_p": F.lit(1 / 256) for c in _PLACES})
        else:
            joined = grams.join(below, "suffix")

        def smoothed(c: str, seen: int) -> Column:
            total, kinds, p = F.col(f"{c}_all"), F.col(f"{c}_kinds"), F.col(f"{c}_p")
            return F.when(total >= seen, (F.col(c) + kinds * p) / (total + kinds)).otherwise(p)

        # Of no text at all nothing is known, not even which bytes there are.
        least = SEEN if width else 1
        known = joined.select("gram", *[smoothed(c, least).alias(f"{c}_p") for c in _PLACES])
        below = known.withColumnRenamed("gram", "suffix")

    def step(part: int) -> Column:
        ratio = F.log(f"{ALLOW}{part}_p") - F.log(f"{BLOCK}{part}_p")
        return F.rint(ratio * _UNIT).cast("long")

    steps = F.array(*map(step, range(HELD + 1)))
    return settle(known.select(F.col("gram").alias("window"), steps.alias("steps")), "url-steps")


def _threshold(ruled: DataFrame) -> float:
    """The threshold with the fewest wrong verdicts among (score, verdict, n), both kinds weighing the same."""
    each = [F.sum(F.when(F.col("verdict") == k, F.col("n")).otherwise(0)).alias(k) for k in (ALLOW, BLOCK)]
    scores = settle(
        ruled.groupBy("score").agg(*each).withColumn("range", F.floor(F.col("score") * _RANGES)),
        "url-scores",
    )
    # A score is a mean of log ratios, so there are some ten thousands of ranges at most.
    ranges = scores.groupBy("range").agg(
        F.sum(ALLOW).alias("good"), F.sum(BLOCK).alias("bad"), F.min("score").alias("least")
    )
    along = Window.orderBy("range")
    ranges = ranges.select(
        "range",
        *[(F.sum(c).over(along) - F.col(c)).alias(f"{c}_before") for c in ("good", "bad")],
        *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("good", "bad")],
        F.lead("least").over(along).alias("beyond"),
    )
    inside = Window.partitionBy("range").orderBy("score")
    lost = (F.sum(ALLOW).over(inside) + F.col("good_before")) / F.col("good_all")
    caught = (F.sum(BLOCK).over(inside) + F.col("bad_before")) / F.col("bad_all")
    after = F.coalesce(F.lead("score").over(inside), F.col("beyond"), F.col("score") + 2)
    cuts = scores.join(ranges, "range").select(
        F.round(lost - caught, 12).alias("wrong"), ((F.col("score") + after) / 2).alias("cut")
    )
    best = cuts.agg(F.min(F.struct("wrong", "cut")).alias("best")).first().best
    # Nothing below the threshold: all that is to be blocked is missed.
    least = scores.agg(F.min("score")).first()[0]
    return float(best.cut if best.wrong < 0 else least - 1)


def fit_all(parts: DataFrame) -> tuple[DataFrame, float] | None:
    """(plain, score) of the texts no rule decides, and the threshold, by models of all that rules do."""
    part = F.pmod(F.xxhash64("plain"), F.lit(HELD)).cast("int").alias("part")
    # A text's copies are one row, with as many rows as it has.
    texts = settle(
        parts.where("plain != ''")
        .groupBy("plain", "verdict")
        .agg(F.count("*").alias("n"))
        .select("*", part, F.monotonically_increasing_id().alias("id")),
        "url-texts",
    )
    held = {
        (r.verdict, r.part): r.n
        for r in texts.where("verdict is not null").groupBy("verdict", "part").agg(F.sum("n").alias("n")).collect()
    }
    own = {k: {part for verdict, part in held if verdict == k} for k in (ALLOW, BLOCK)}
    if not all(own.values()):
        return None
    # Where a part has all of one verdict, the models without it know none: it is not left out.
    whole = [part for part in range(HELD) if {part} in own.values()]
    place = F.when(F.col("verdict").isNull() | F.col("part").isin(whole), HELD).otherwise(F.col("part"))
    steps = _steps(_counted(texts))
    sums = (
        _windows(texts.withColumn("place", place), "id", "place")
        .join(steps, "window")
        .groupBy("id")
        .agg(F.sum(F.get("steps", F.col("place"))).alias("total"))
    )
    score = F.col("total") / _UNIT / (F.octet_length("plain") + 1)
    scored = settle(texts.join(sums, "id").select("plain", "verdict", "n", score.alias("score")), "url-ratios")
    threshold = _threshold(scored.where("verdict is not null"))
    return scored.where("verdict is null").select("plain", "score"), threshold


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    sample: int | None = SAMPLE,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the score where the method decided.

    ``sample=None``: models and threshold of all URLs that a rule decides.
    """
    parts = with_rule(with_parts(pages.select("page_id", "url")), rules)
    if sample is None:
        scored, threshold = _judged_by_all(parts.withColumn("plain", _plain_text()))
    else:
        scored, threshold = _judged_by_sample(parts, sample)
    own = F.when(F.col("score") < threshold, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score"
    )


def _unscored(parts: DataFrame) -> DataFrame:
    return parts.withColumn("score", F.lit(None).cast("double"))


def _judged_by_all(parts: DataFrame) -> tuple[DataFrame, float]:
    found = fit_all(parts)
    if found is None:
        return _unscored(parts), 0.0
    scores, threshold = found
    open_ = F.col("rule").isNull() & (F.col("plain") != "")
    judged = parts.where(open_).join(scores, "plain", "left").select(*parts.columns, "score")
    return _unscored(parts.where(~open_)).unionByName(judged), threshold


def _judged_by_sample(parts: DataFrame, sample: int) -> tuple[DataFrame, float]:
    ratio = fit(parts.where("verdict is not null"), sample)
    if ratio is None:
        return _unscored(parts), 0.0
    # Only URLs without a rule go to the models.
    rest = parts.where("rule is null").withColumn("score", _scores(ratio))
    return _unscored(parts.where("rule is not null")).unionByName(rest), ratio.threshold
