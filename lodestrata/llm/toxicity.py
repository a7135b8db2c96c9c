"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of itself and its character 3- to 5-grams, hashed into BUCKETS; a bag
is the mean of its words, and a linear softmax classifies it. Embeddings and softmax are trained together by Adagrad, so
an unseen misspelling shares its n-grams' vectors. Bags are windows of WINDOW words: in the first
epochs every window of a toxic document is positive, later only those the model then finds toxic, and at least the
highest. A document's logit is that of its highest window, calibrated on a part of the sample kept from training.

As mean and softmax are linear, scoring needs one number per word, looked up once while it is cached.

The model is fitted on a bounded sample: about SAMPLE_DOCS labelled documents that aren't held out, chosen by
hash, none longer than SAMPLE_CHARS.

Defined results: null, empty and wordless texts get the score of a bag without words; of several labels of one id
the highest counts; without labels of both classes every score is the share of label 1; repeated rows get repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_arrow, sampled, slices, text_of

SAMPLE_DOCS = 8000
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 17
DIMENSIONS = 6
WINDOW = 8
GAIN = 16.0
THRESHOLD = 0.3
EPOCHS = 7
STEPS = 3000
RATE = 0.1
DECAY = 2e-6
#: Documents of the sample that a subword must occur in to be learnt.
MIN_DOCS = 4
WORD = re.compile(r"[^\W_]+")
_CACHE = 300_000


def subwords(word: str) -> list[int]:
    marked = f"<{word}>"
    raw = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in raw]


class Model:
    """weight: one logit per bucket, from embeddings and softmax; slope and shift calibrate a document's highest window."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.bias, self.slope, self.shift = weight, bias, slope, shift

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30))))


def highest(values: np.ndarray) -> float:
    """Highest mean of a window of WINDOW words; of all words, if there are fewer."""
    if not len(values):
        return 0.0
    if len(values) <= WINDOW:
        return float(values.mean())
    c = np.concatenate([[0.0], np.cumsum(values)])
    return float((c[WINDOW:] - c[:-WINDOW]).max() / WINDOW)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def word(self, word: str) -> float:
        return float(self.model.weight[subwords(word)].mean())

    def logit(self, text: str) -> float:
        words = WORD.findall(text.lower())
        cache = self.cache
        new = {w for w in words if w not in cache}
        if new:
            if len(cache) + len(new) > _CACHE:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = self.word(w)
        return highest(np.fromiter(map(cache.__getitem__, words), np.float64, len(words))) + self.model.bias

    def score(self, text: str) -> float:
        return self.model.probability(self.logit(text))


def fit(texts: Sequence[str], labels: Sequence[int], seed: int = 5, epochs: int = EPOCHS) -> Model:
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    flat = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if len(set(labels)) < 2:
        return flat
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())], np.int64) for t in texts]
    subs = [np.array(subwords(w)) for w in vocabulary]
    spread = np.bincount(np.concatenate([np.unique(np.concatenate([subs[w] for w in np.unique(d)])) for d in docs if len(d)] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    common = spread >= MIN_DOCS  # rarer subwords would only be learnt by heart; they keep weight 0
    size = np.array([len(s) for s in subs], np.int64)
    flat_subs = np.concatenate(subs) if subs else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    calibrating = rng.random(len(docs)) < 0.2
    windows = [(d, i, min(i + WINDOW, len(docs[d]))) for d in range(len(docs)) if not calibrating[d] for i in range(0, len(docs[d]), WINDOW)]
    owner = np.array([w[0] for w in windows], np.int64)
    if not len(windows) or len(set(y[owner].tolist())) < 2:
        return flat
    positive, negative = np.flatnonzero(y[owner] == 1), np.flatnonzero(y[owner] == 0)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32) * common[:, None]
    epochs = max(epochs, -(-STEPS * 256 // (len(positive) + min(len(negative), max(4 * len(positive), 2000)))))
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_w, seen_b = np.full(embedding.shape, 1e-6, np.float32), np.full(softmax.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    touched = np.zeros(BUCKETS, bool)
    summed, summed_bias, n_summed = np.zeros(BUCKETS), 0.0, 0

    def word_logits() -> np.ndarray:
        per = GAIN * (embedding @ (softmax[:, 1] - softmax[:, 0]))
        return np.add.reduceat(per[flat_subs], at[:-1]) / size

    for epoch in range(epochs):
        chosen = positive
        if epoch >= max(2, epochs // 3):
            w = word_logits()
            means = np.array([w[docs[windows[k][0]][windows[k][1] : windows[k][2]]].mean() for k in positive]) + bias[1] - bias[0]
            top: dict[int, tuple[float, int]] = {}
            for m, k in zip(means.tolist(), positive.tolist(), strict=True):
                top[owner[k]] = max(top.get(owner[k], (-1e9, -1)), (m, k))
            chosen = np.array(sorted({k for m, k in zip(means.tolist(), positive.tolist(), strict=True) if m > 0} | {k for _, k in top.values()}))
        others = rng.choice(negative, min(len(negative), max(4 * len(chosen), 2000)), replace=False)
        order = rng.permutation(np.concatenate([chosen, others]))
        for lo in range(0, len(order), 256):
            batch = [windows[k] for k in order[lo : lo + 256]]
            tokens = np.concatenate([docs[d][i:j] for d, i, j in batch])
            n = np.array([j - i for _, i, j in batch])
            row = np.repeat(np.arange(len(batch)), n)
            used, back = np.unique(tokens, return_inverse=True)
            ids = np.concatenate([subs[u] for u in used])
            word = np.repeat(np.arange(len(used)), size[used])
            vectors = np.stack([np.bincount(word, embedding[ids, k], len(used)) for k in range(DIMENSIONS)], 1) / size[used, None]
            bags = np.stack([np.bincount(row, vectors[back, k], len(batch)) for k in range(DIMENSIONS)], 1) / n[:, None]
            z = GAIN * bags @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            target = y[[d for d, _, _ in batch]]
            p[np.arange(len(batch)), target] -= 1
            p /= len(batch)
            grad_w, grad_b, grad_bag = GAIN * bags.T @ p, p.sum(0), GAIN * p @ softmax.T
            per_token = (grad_bag / n[:, None])[row]
            grad_word = np.stack([np.bincount(back, per_token[:, k], len(used)) for k in range(DIMENSIONS)], 1) / size[used, None]
            learnt = common[ids]
            ids, word = ids[learnt], word[learnt]
            unique, which = np.unique(ids, return_inverse=True)
            grad_e = np.stack([np.bincount(which, grad_word[word, k], len(unique)) for k in range(DIMENSIONS)], 1) + DECAY * embedding[unique]
            seen_e[unique] += grad_e**2
            embedding[unique] -= RATE * grad_e / np.sqrt(seen_e[unique])
            seen_w += grad_w**2
            softmax -= RATE * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= RATE * grad_b / np.sqrt(seen_b)
            touched[unique] = True
        if epoch >= epochs // 2:
            summed += GAIN * (embedding @ (softmax[:, 1] - softmax[:, 0]))
            summed_bias += float(bias[1] - bias[0])
            n_summed += 1
    # The mean over the later epochs depends less on what was drawn last.
    weight = np.where(touched, summed / n_summed, 0).astype(np.float32)
    model = Model(weight, summed_bias / n_summed, 1.0, 0.0)
    w = np.add.reduceat(weight[flat_subs], at[:-1]) / size
    held = [d for d in range(len(docs)) if calibrating[d]] or list(range(len(docs)))
    if len({int(y[d]) for d in held}) < 2:
        held = list(range(len(docs)))
    x = np.array([highest(w[docs[d]]) + model.bias for d in held])
    model.slope, model.shift = calibrate(x, y[held])
    return model


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a lightly regularised logistic fit, by Newton steps; the slope is never negative."""
    scale = max(float(np.std(x)), 1e-6)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta += np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * beta)
        beta = np.clip(beta, -60, 60)
    return max(0.0, float(beta[0])) / scale, float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of labelled documents that aren't held out."""
    learn = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    learn = learn.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = learn.count()
    chosen = learn.where(sampled(min(1.0, sample_docs / max(1, n)), "doc_id"))
    texts = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    # Ids that repeat can't swell the sample: it ends at twice its size, in the order of a hash.
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").distinct()
    rows = found.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * sample_docs).toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), rows["label"].to_pylist(), strict=True))
    return fit([r[1] for r in rows], [int(r[2] > 0) for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    bc = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bc.value)
        for part in slices(batches):
            scores = np.array([scorer.score(t) for t in text_of(part).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return in_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), run, schema)
