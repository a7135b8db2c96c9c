"""Language identification with word-first backoff.

A known word scores its per-language log frequency. An unseen word falls back to its character
n-grams, the longest length of which any is known, down to single characters. The document's score is
the posterior of the summed word scores, tempered so that no more than EVIDENCE words count.

The model is fitted on a bounded sample of labelled documents: about SAMPLE_DOCS of each language, chosen by
hash of the text over all lengths, equal texts once; of a longer text the first SAMPLE_CHARS characters count, taken between its
letters, so that a long lead without words doesn't hide a language. WORDS and GRAMS bound the model's size.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if
nothing was learnt; ties go to the first language in order; repeated rows get repeated results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import batched, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import release
from .common import held_out, in_arrow, sampled, slices, text_of

SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
WORDS = 60_000
GRAMS = 120_000
LONGEST = 4
EVIDENCE = 20
MAX_LANGUAGES = 2000
UNKNOWN = "und"
_CACHE = 120_000
#: Unseen words whose grams are gathered at once.
BLOCK = 256


RUN = re.compile(r"[^\W\d_]+")
#: Runs of letters only: neither superscripts, fractions nor numerals, which RUN takes for letters.
LETTERS = re.compile(rf"[^\W\d_{''.join(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())}]+")


def words_of(text: str) -> list[str]:
    words = RUN.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in LETTERS.findall(w)]


class Table(Mapping):
    """Rows of a matrix by name."""

    def __init__(self, ids: dict[str, int], rows: np.ndarray):
        self.ids, self.rows = ids, rows

    def __getitem__(self, name: str) -> np.ndarray:
        return self.rows[self.ids[name]]

    def __iter__(self) -> Iterator[str]:
        return iter(self.ids)

    def __len__(self) -> int:
        return len(self.ids)


class Model:
    def __init__(self, samples: Iterable[tuple[str, str]]):
        """samples: (language, text)."""
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in samples:
            words[lang].update(words_of(text))
        self.languages = sorted(lang for lang in words if words[lang])
        n = len(self.languages)
        total: Counter = Counter()
        for lang in self.languages:
            total.update(words[lang])
        known = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:WORDS]]
        counts = np.array([[words[lang][w] for lang in self.languages] for w in known], float).reshape(len(known), n)
        self.words = Table({w: i for i, w in enumerate(known)}, self._logs(counts, np.array([sum(words[x].values()) for x in self.languages], float)))
        ids: list[dict[str, int]] = [{}]
        rows: list[np.ndarray] = []
        row = count()
        # One length after another: the driver holds the grams of one, and those that stay.
        for size in range(1, LONGEST + 1):
            names, counts = self._counted(words, size)
            sums = counts.sum(axis=1)
            best = sorted(range(len(names)), key=lambda i: (-sums[i], names[i]))[: GRAMS // LONGEST]
            ids.append({names[i]: next(row) for i in best})
            rows.append(self._logs(counts[best], counts.sum(axis=0) if names else np.ones(n)))
        #: With a last row of zeros for words of which nothing is known.
        self.gram_rows = np.concatenate([*rows, np.zeros((1, n))])
        self.grams = [Table(x, self.gram_rows) for x in ids]

    def _counted(self, words: dict[str, Counter], size: int) -> tuple[list[str], np.ndarray]:
        """The grams of one length, and how often each language has them."""
        n = len(self.languages)
        ids: dict[str, int] = {}
        counts = np.zeros((1024, n))
        for k, lang in enumerate(self.languages):
            for w, c in words[lang].items():
                for g in self._grams_of(w, size):
                    at = ids.setdefault(g, len(ids))
                    if at == len(counts):
                        counts = np.concatenate([counts, np.zeros_like(counts)])
                    counts[at, k] += c
        return list(ids), counts[: len(ids)]

    @staticmethod
    def _grams_of(word: str, size: int) -> list[str]:
        if size == 1:
            return list(word)
        marked = f"^{word}$"
        return [marked[i : i + size] for i in range(len(marked) - size + 1)]

    @staticmethod
    def _logs(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Smoothed log frequencies: a row for each name, a column for each language."""
        smooth = 0.1
        return np.log(counts + smooth) - np.log(totals + smooth * (len(counts) + 1))

    def backoff(self, words: Sequence[str]) -> np.ndarray:
        """Scores of unseen words, a row for each."""
        ids: list[int] = []
        counts, shares = np.ones(len(words), np.int64), np.ones(len(words))
        for k, word in enumerate(words):
            for size in range(LONGEST, 0, -1):
                table = self.grams[size].ids
                seen = [table[g] for g in self._grams_of(word, size) if g in table]
                if seen:
                    ids += seen
                    counts[k], shares[k] = len(seen), min(1.0, size / LONGEST)
                    break
            else:
                ids.append(len(self.gram_rows) - 1)
        sums = np.add.reduceat(self.gram_rows[ids], np.cumsum(counts) - counts)
        return sums / counts[:, None] * shares[:, None]


class Scorer:
    """Scores of texts under a model; distinct words are looked up once while they are in the cache."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        words = self.model.words
        self.index = dict(words.ids)
        #: Its first rows are the index's; those of the model are copied when the first new word is added.
        self.matrix, self.filled = words.rows, len(words)

    def score(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        index = self.index
        new = {w for w in words if w not in index}
        if new:
            if len(index) + len(new) > _CACHE + len(self.model.words):
                self.reset()
                index = self.index
                new = {w for w in words if w not in index}
            for block in batched(new, BLOCK):
                end = self.filled + len(block)
                if end > len(self.matrix):
                    grown = np.empty((max(1024, 2 * end), self.matrix.shape[1]))
                    grown[: self.filled] = self.matrix[: self.filled]
                    self.matrix = grown
                self.matrix[self.filled : end] = self.model.backoff(block)
                index.update(zip(block, range(self.filled, end), strict=True))
                self.filled = end
        ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        mean = self.matrix[ids].mean(axis=0)
        z = (mean - mean.max()) * min(len(words), EVIDENCE)
        p = np.exp(z)
        best = int(np.argmax(p))
        return self.model.languages[best], float(p[best] / p.sum())


def train(docs: DataFrame) -> Model:
    """Learn from text and non-null lang of documents that aren't held out."""
    learn = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model([])
    each = max(1, min(SAMPLE_DOCS, 20 * SAMPLE_DOCS // len(counts)))
    fractions = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, ld_fraction double")
    lead = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, SAMPLE_CHARS)
    text = F.when(F.length("text") > SAMPLE_CHARS, lead).otherwise(F.col("text")).alias("text")
    rows = learn.join(F.broadcast(fractions), "lang").where(sampled(F.col("ld_fraction"), "text")).select("lang", text).distinct().toArrow()
    return Model(pair for part in slices(rows.to_batches()) for pair in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True))


def shared_model(docs: DataFrame, model: Model | None):
    """The model as a broadcast; what the driver's Python took to learn it goes back to the system."""
    bc = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    release()
    return bc


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float]]]]:
    scorer = Scorer(model.value)
    for part in slices(batches):
        yield part, [scorer.score(t) for t in text_of(part).to_pylist()]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    bc = shared_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(batches, bc):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return in_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), run, schema)


def keep_identified(docs: DataFrame, min_score: float = 0.5, model: Model | None = None) -> DataFrame:
    """Documents whose language is found with at least min_score, with all columns."""
    bc = shared_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(batches, bc):
            yield part.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in found], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
