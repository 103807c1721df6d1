"""Toxicity by maximum-scoring segments.

Token log-odds with Dirichlet priors: the toxic share of the texts that use a word is smoothed towards that of its
five-letter stem, the stem's towards its four-letter stem, and that towards the share of all texts, so new inflections
of known words count; log-odds within their standard error shrink towards 0. A linear-time scan over a text's word scores finds all maximal segments; a segment's significance follows the
extreme-value law of maximal segments in clean texts, E = K * words * exp(-lambda * score), with K and lambda fitted
to the upper tail of clean training texts. A text's score is a logistic function of the log E of its best segment and of
the summed scores of its three best.

The model learns from labelled rows, at most TRAIN_ROWS (those of least hash, a documented parameter); of texts with one
label, about one number of distinct words and the same four longest ones, which near copies share, it takes one.
Counts of one half score the other half when the law and the logistic function are fitted. A null or empty text, or one
without words, has no segments; its score is that of one word without any. Repeated rows get equal scores; texts are scanned
whole. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmill.llm.common import table

#: At most so many labelled texts are used to learn.
TRAIN_ROWS = 20_000
#: Strength of each prior, in texts.
ALPHA = 6.0
#: Words of fewer texts say only what their stems say.
MIN_COUNT = 3
#: Log-odds taken off each word, so that clean text drifts down.
DRIFT = 0.25
#: Smaller positive log-odds count as none: else a plain word that a text repeats adds up.
TELLING = 1.0
#: Log-odds of so many standard errors are halved.
SHRINK = 3.0
#: A segment of a smaller E value is significant.
SIGNIFICANT = 0.05
#: Entries of a worker's memo of words; it is emptied when full.
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> list[str]:
    """The word and its stems, longest first; stems end in a star."""
    return [word, *(word[:n] + "*" for n in (5, 4) if len(word) >= n)]


@dataclass
class Model:
    log_odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            odds = next((s for u in units(word) if (s := self.log_odds.get(u)) is not None), 0.0)
            got = (0.0 if 0 < odds < TELLING else odds) - DRIFT
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words; all maximal scoring segments as (first word, end, score)."""
        words = _WORD.findall((text or "").lower())
        return len(words), maximal_segments(np.fromiter(map(self.word_score, words), float, len(words)))

    def log_e(self, score: float, n: int) -> float:
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def evidence(self, n: int, scores: list[float]) -> tuple[float, float]:
        """-log E of the best segment and the summed scores of the three best, within bounds."""
        best = sorted(scores, reverse=True)[:3]
        return max(-20.0, min(40.0, -self.log_e(best[0] if best else 0.0, n))) / 5, min(60.0, sum(best)) / 5

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Score, and significant segments as (first, end, score, E)."""
        n, found = self.segments(text)
        with_e = [(a, b, s, self.log_e(s, n)) for a, b, s in found]
        kept = [(a, b, s, math.exp(e)) for a, b, s, e in with_e if e < math.log(SIGNIFICANT)]
        return self.probability(*self.evidence(n, [s for *_, s in found])), kept

    def probability(self, best: float, summed: float) -> float:
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * summed
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in one pass. Each candidate keeps the sums before it and up to its end, and the place
    of the nearest candidate before it with a smaller sum before; a new one looks back along these links only, and merges
    with the one it finds where that ends lower. So each candidate is passed over at most once."""
    totals = np.cumsum(score)
    at = np.flatnonzero(score > 0)
    open_: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum up to end, link
    for i, own, total in zip(at.tolist(), score[at].tolist(), totals[at].tolist(), strict=True):
        first, before, j = i, total - own, len(open_) - 1
        while True:
            while j >= 0 and open_[j][2] >= before:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= total:
                break
            first, _, before, _, link = open_[j]
            del open_[j:]
            j = link
        open_.append((first, i + 1, before, total, j))
    return [(a, b, r - l) for a, b, l, r, _ in open_]


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Smoothed and shrunk log-odds of each unit. counts: toxic and clean texts with it, of so many in all."""
    base = (toxic + 1) / (toxic + clean + 2)
    priors: dict[str, float] = {}

    def prior(unit: str) -> float:
        """The smoothed share of the next shorter stem that was seen."""
        word = unit.rstrip("*")
        for n in (5, 4):
            stem = word[:n] + "*"
            if len(word) >= n and len(stem) <= len(unit) and stem != unit and stem in counts:
                if stem not in priors:
                    priors[stem] = (counts[stem][0] + ALPHA * prior(stem)) / (sum(counts[stem]) + ALPHA)
                return priors[stem]
        return base

    def certainty(unit: str) -> float:
        """How far the unit's own counts, under the prior of all texts, stand out of their standard error."""
        t, c = counts[unit][0] + ALPHA * base, counts[unit][1] + ALPHA * (1 - base)
        z2 = (math.log(t / c) - math.log(base / (1 - base))) ** 2 / (1 / t + 1 / c)
        return z2 / (z2 + SHRINK * SHRINK)

    out = {}
    for unit, (t, c) in counts.items():
        rho = min(max(prior(unit), 0.01), 0.95)
        odds = math.log((t + ALPHA * rho) / (c + ALPHA * (1 - rho))) - math.log(base / (1 - base))
        # a word is as certain as its stem: few uses of a known stem's inflection are enough
        out[unit] = odds * max(certainty(u) for u in {unit, *units(unit.rstrip("*"))} if u in counts and len(u) <= len(unit) + 1)
    return out


def fitted_law(scores: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and log K of the extreme-value law from best scores of clean texts of n words: through two upper quantiles,
    corrected for length in turn."""
    low, high = 0.90, 0.99
    spread = math.log(-math.log(low)) - math.log(-math.log(high))
    lam = 1.0
    for _ in range(50):
        rest = scores - np.log(np.maximum(n, 1)) / lam
        a, b = np.quantile(rest, [low, high])
        lam = 0.5 * lam + 0.5 * min(10.0, spread / max(float(b - a), 1e-3))
    a = float(np.quantile(scores - np.log(np.maximum(n, 1)) / lam, low))
    return lam, lam * a + math.log(-math.log(low))


def fitted_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression with an intercept by Newton steps, each halved until the loss falls."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.array([1e-6] + [1e-2] * x.shape[1])
    loss = lambda w: float(np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * (ridge * w * w).sum())
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), a.T @ (y - p) - ridge * w)
        scale = 1.0
        while scale > 1e-6 and not loss(w + scale * step) < now:
            scale /= 2
        if scale <= 1e-6:
            break
        w, before = w + scale * step, now
        now = loss(w)
        if before - now < 1e-10 * max(1.0, now):
            break
    return float(w[0]), float(w[1]), float(w[2])


def held_out(doc_id) -> bool:
    """Column: rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, str], list[int]] = {}

    def out():
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], names=["fold", "unit", "toxic", "clean"])

    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(x).to_pylist() for x in ("text", "fold", "toxic")), strict=True):
            words = _WORD.findall((text or "").lower())
            for unit in {"", *(u for w in set(words) for u in units(w))}:
                counts.setdefault((fold, unit), [0, 0])[0 if toxic else 1] += 1
            if len(counts) > MEMO:
                yield out()
                counts.clear()
    yield out()


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic); rows of held_out() are left out."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # three numbers a row, broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text is not null")
    # copies and near copies count once: else a group of them makes its plain words telling
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    longest = F.slice(F.sort_array(F.transform(words, lambda w: F.struct(-F.length(w), w))), 1, 4)
    same = F.xxhash64(longest, F.round(F.log2(F.size(words).cast("double"))))
    rows = rows.groupBy(same.alias("h"), "toxic").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    rows = rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("h", F.lit("fold")), F.lit(2)).cast("int").alias("fold"))
    counted = rows.mapInArrow(_count_units, "fold int, unit string, toxic long, clean long").groupBy("fold", "unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.groupBy("unit").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}") for f in (0, 1) for c in ("toxic", "clean")]).na.fill(0)
    # units of few texts are left on the executors; the rest is bounded by the sample
    got = counted.filter(F.col("toxic0") + F.col("toxic1") + F.col("clean0") + F.col("clean1") >= MIN_COUNT).collect()

    def model(folds: tuple[int, ...]) -> Model:
        counts = {r.unit: (sum(r[f"toxic{f}"] for f in folds), sum(r[f"clean{f}"] for f in folds)) for r in got}
        all_toxic, all_clean = counts.pop("", (0, 0))
        counts = {u: c for u, c in counts.items() if sum(c) >= MIN_COUNT}
        return Model(log_odds(counts, all_toxic, all_clean))

    halves = [model((1,)), model((0,))]
    both = spark.sparkContext.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fold, toxic in zip(*(batch.column(x).to_pylist() for x in ("text", "fold", "toxic")), strict=True):
                n, found = both.value[fold].segments(text)
                out.append((n, toxic, [s for *_, s in found]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["n", "toxic", "scores"])

    seen = [r for r in rows.mapInArrow(measure, "n long, toxic int, scores array<double>").collect() if r.n]
    out = model((0, 1))
    clean = [(max(r.scores, default=0.0), r.n) for r in seen if not r.toxic]
    if not clean or len(clean) == len(seen):
        return out
    out.lam, out.log_k = fitted_law(np.array([s for s, _ in clean]), np.array([n for _, n in clean]))
    x = np.array([out.evidence(r.n, list(r.scores)) for r in seen])
    out.weights = fitted_logistic(x, np.array([float(bool(r.toxic)) for r in seen]))
    return out


SEGMENTS = "struct<score: double, segments: array<struct<first: int, end: int, score: double, e_value: double>>>"


def scorer(spark, model: Model) -> Callable:
    """Column function: text -> struct of score and significant segments (word positions)."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the bounded sample that it comes from

    @F.arrow_udf(SEGMENTS)
    def scored(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for text in texts.to_pylist():
            score, kept = m.judged(text)
            out.append({"score": score, "segments": [dict(zip(("first", "end", "score", "e_value"), k, strict=True)) for k in kept]})
        kind = pa.struct([("score", pa.float64()), ("segments", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])))])
        return pa.array(out, kind)

    return scored


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(spark, model)(F.col("text")).alias("t"))
    return scored.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.size("t.segments").alias("n_segments"))
