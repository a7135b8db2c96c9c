"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the
counts of vote patterns of the whole corpus (at most 3 ** labellers of them) estimates each labeller's accuracies
and gives each pattern a posterior. Posterior labels train a linear scorer over hashed byte 4-grams and coarse
statistics, which then scores every whole text.

The scorer is fitted on a bounded sample: about SAMPLE_DOCS distinct texts chosen by their hash, none longer than
SAMPLE_BYTES. Votes, patterns and posteriors cover all documents.

Defined results: null, empty and wordless texts are bad (score 0, label 0); repeated rows count and score
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, in_arrow, lowered, mixed, prefix_hash, raw, sampled, slices, span_hash, stored, text_of, word_spans

SAMPLE_DOCS = 4000
SAMPLE_BYTES = 12_000
BUCKETS = 1 << 17
PRIOR = 3.0
LABELLERS = ("symbols", "capitals", "word_length", "stutter", "lines", "function_words", "sentences", "length")

#: Frequent function words of English, German, French and Spanish: fixed values.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das den dem ist nicht ein eine zu mit auf im als von für sich des es auch "
    "le la les de des et un une que qui dans pour est pas sur au par plus ne se ce avec du "
    "el los las y en del se por con no una su para es al lo como más o"
).split()

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = WORD_BYTE.copy()
_LETTER[0x30:0x3A] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\"'):;,"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = lowered(pa.array(words, pa.large_string()))
    return np.unique(span_hash(prefix_hash(data), offsets[:-1], offsets[1:]))


class Statistics:
    """Per-text statistics of a slice."""

    def __init__(self, texts: pa.Array):
        data, offsets = raw(texts)
        n = len(offsets) - 1
        self.data, self.offsets, self.size = data, offsets, np.diff(offsets)
        share = lambda mask, of: self._sums(mask) / np.maximum(1, of)
        self.symbols = share(_SYMBOL[data], self.size)
        self.capitals = share(_UPPER[data], self._sums(_LETTER[data]))
        low, low_offsets = lowered(texts)
        starts, ends, first = word_spans(low, low_offsets)
        h = span_hash(prefix_hash(low), starts, ends)
        self.words = np.diff(first)
        doc = np.repeat(np.arange(n), self.words)
        many = np.maximum(1, self.words)
        self.word_length = np.bincount(doc, ends - starts, n) / many
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        self.stutter = np.bincount(doc, same, n) / many
        self.function_words = np.bincount(doc, np.isin(h, _FUNCTION), n) / many
        # Lines: ends at each newline and at the text's end.
        newline = np.flatnonzero(data == 0x0A)
        line_end = np.sort(np.concatenate([newline, offsets[1:]]))
        line_start = np.concatenate([[0], line_end[:-1] + (np.isin(line_end[:-1], newline))]) if len(line_end) else line_end
        line_doc = np.minimum(np.searchsorted(offsets, line_start, "right") - 1, max(n - 1, 0))
        full = line_end > line_start
        line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
        lh = mixed(span_hash(prefix_hash(data), line_start, line_end) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        lines = np.bincount(line_doc, minlength=n)
        _, at = np.unique(lh, return_index=True)
        self.n_lines = lines
        self.repeated_lines = 1 - np.bincount(line_doc[at], minlength=n) / np.maximum(1, lines)
        self.ended = np.bincount(line_doc, _STOP[data[line_end - 1]] if len(line_end) else None, n) / np.maximum(1, lines) if len(line_end) else np.zeros(n)

    def _sums(self, mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def votes(self) -> np.ndarray:
        """n x labellers: 1 good, -1 bad, 0 abstains."""

        def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
            return good.astype(np.int8) - bad.astype(np.int8)

        never = np.zeros(len(self.words), bool)
        return np.stack(
            [
                vote(never, self.symbols > 0.04),
                vote(never, self.capitals > 0.3),
                vote((self.word_length >= 3) & (self.word_length <= 6.3), (self.word_length < 2.5) | (self.word_length > 7.5)),
                vote(never, self.stutter > 0.15),
                vote((self.repeated_lines < 0.15) & (self.n_lines >= 2), self.repeated_lines > 0.4),
                vote(self.function_words > 0.15, (self.function_words < 0.05) & (self.words >= 10)),
                vote(self.ended > 0.6, (self.ended < 0.1) & (self.words >= 10)),
                vote(self.words >= 50, self.words < 5),
            ],
            axis=1,
        )

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every byte 4-gram with the row it belongs to; grams don't cross texts."""
        if len(self.data) < 4:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(len(self.data) - 3)
        row = np.repeat(np.arange(len(self.size)), self.size)[: len(at)]
        inside = at + 4 <= self.offsets[row + 1]
        h = prefix_hash(self.data)
        at, row = at[inside], row[inside]
        return (span_hash(h, at, at + 4) >> np.uint64(47)).astype(np.int64), row

    def coarse(self) -> np.ndarray:
        """n x k columns of clipped statistics."""
        return np.stack([np.minimum(10 * self.symbols, 2), 2 * self.capitals, np.clip(self.word_length / 5 - 1, -1, 1), np.minimum(4 * self.stutter, 2), self.repeated_lines, np.minimum(4 * self.function_words, 2), self.ended, np.log1p(self.words) / 7], axis=1)


_FUNCTION = _hash_words(FUNCTION_WORDS)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, each labeller's vote rates (class x labeller x vote), and the share of good."""
    k, l = patterns.shape
    counts = counts.astype(float)
    # Heuristics mostly rule out one fault each: start from any fault found.
    post = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    rates = np.zeros((2, l, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for v in (-1, 0, 1):
            rates[:, :, v + 1] = weight @ (patterns == v) + 0.5
        # Prior belief, worth PRIOR times the good documents: a fault is seldom found in a good document.
        rates /= rates.sum(axis=2, keepdims=True)
        fault = rates[1, :, 0] / (1 + PRIOR)
        rates[1, :, 1:] *= ((1 - fault) / (1 - rates[1, :, 0]))[:, None]
        rates[1, :, 0] = fault
        log = np.tile(np.log([[1 - prior], [prior]]), (1, k))
        for j in range(l):
            log += np.log(rates[:, j, :][:, patterns[:, j] + 1])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            post = new
            break
        post = new
    return post, rates, float(prior) if k else 0.5


class Scorer:
    def __init__(self, weight: np.ndarray, coarse: np.ndarray, bias: float):
        self.weight, self.coarse, self.bias = weight, coarse, bias

    def score(self, s: Statistics) -> np.ndarray:
        bucket, row = s.features()
        n = len(s.size)
        mean = np.bincount(row, self.weight[bucket], n) / np.maximum(1, np.bincount(row, minlength=n)) if len(row) else np.zeros(n)
        z = mean + s.coarse() @ self.coarse + self.bias
        return np.where(s.words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit_scorer(texts: list[str], posterior: np.ndarray, rounds: int = 60) -> Scorer:
    """Logistic regression on posterior labels, both classes with equal weight, by Adam over the whole sample."""
    weight, coarse_w, bias = np.zeros(BUCKETS), np.zeros(len(LABELLERS)), 0.0
    if not texts:
        return Scorer(weight.astype(np.float32), coarse_w, 0.0)
    buckets, rows, coarse, done, words = [], [], [], 0, []
    for lo in range(0, len(texts), 256):
        s = Statistics(pa.array(texts[lo : lo + 256], pa.large_string()))
        b, r = s.features()
        # A text's distinct buckets with their shares.
        key, n = np.unique(r * BUCKETS + b, return_counts=True)
        buckets.append((key % BUCKETS).astype(np.int32))
        total = np.bincount(r, minlength=len(s.size))
        rows.append(np.stack([key // BUCKETS + done, n / np.maximum(1, total[key // BUCKETS])]))
        coarse.append(s.coarse())
        words.append(s.words)
        done += len(s.size)
    bucket, row, share, x = np.concatenate(buckets), np.concatenate([r[0] for r in rows]).astype(np.int32), np.concatenate([r[1] for r in rows]), np.concatenate(coarse)
    p = np.asarray(posterior, float)
    importance = p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9)
    importance /= importance.sum()
    m, v = np.zeros(BUCKETS + len(LABELLERS) + 1), np.zeros(BUCKETS + len(LABELLERS) + 1)
    theta = np.zeros_like(m)
    for t in range(1, rounds + 1):
        z = np.bincount(row, theta[bucket] * share, len(p)) + x @ theta[BUCKETS:-1] + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) * importance
        grad = np.concatenate([np.bincount(bucket, error[row] * share, BUCKETS), x.T @ error, [error.sum()]]) + 1e-7 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Scorer(theta[:BUCKETS].astype(np.float32), theta[BUCKETS:-1], float(theta[-1]))


def vote_table(docs: DataFrame) -> DataFrame:
    """Stored doc_id, pattern (one character +, -, 0 per labeller) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            votes = Statistics(text_of(part)).votes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["".join("-0+"[v + 1] for v in row) for row in votes.tolist()], pa.string())], ["doc_id", "pattern"])

    return stored(in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern string"), "votes")


def posteriors(votes: DataFrame) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Posterior of each vote pattern, and each labeller's accuracy in both classes."""
    found = sorted((r["pattern"], r["n"]) for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = np.array([["-0+".index(c) - 1 for c in p] for p, _ in found], np.int64).reshape(len(found), len(LABELLERS))
    post, rates, _ = em(patterns, np.array([n for _, n in found], float))
    accuracy = {name: {"good": float(rates[1, j, 2] / max(1e-9, 1 - rates[1, j, 1])), "bad": float(rates[0, j, 0] / max(1e-9, 1 - rates[0, j, 1]))} for j, name in enumerate(LABELLERS)}
    return dict(zip((p for p, _ in found), post.tolist(), strict=True)), accuracy


def classify_quality(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, votes, posterior, score, label (1 good)."""
    spark = docs.sparkSession
    votes = vote_table(docs)
    post, _ = posteriors(votes)
    n = votes.count()
    # By the text's own hash and distinct, so that neither null or repeated ids nor copies swell the sample.
    chosen = docs.select("text").where(F.octet_length("text").between(1, SAMPLE_BYTES) & sampled(min(1.0, sample_docs / max(1, n)), "text")).distinct()
    texts = sorted(chosen.toArrow()["text"].to_pylist())
    stats = [Statistics(pa.array(texts[lo : lo + 256], pa.large_string())).votes() for lo in range(0, len(texts), 256)]
    labels = [post.get("".join("-0+"[v + 1] for v in row), 0.5) for part in stats for row in part.tolist()]
    shared = spark.sparkContext.broadcast((fit_scorer(texts, np.array(labels)), post))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = shared.value
        for part in slices(batches):
            s = Statistics(text_of(part))
            patterns = ["".join("-0+"[v + 1] for v in row) for row in s.votes().tolist()]
            score = scorer.score(s)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(patterns, pa.string()), pa.array([known.get(p, 0.5) for p in patterns], pa.float64()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "votes", "posterior", "score", "label"],
            )

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes string, posterior double, score double, label int")
