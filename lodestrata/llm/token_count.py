"""Token counts of a unigram tokenizer without making tokens.

A text is cut into words before each space mark. In a word, an Aho-Corasick automaton enumerates the
vocabulary's matches, and a dynamic programme over end positions carries only the best score and the number of
pieces. Ties keep the earlier start, which is what a forward lattice that replaces on strictly better scores
does. A character that no piece of one character covers may stand alone at the least score less 10, and counts as its
UTF-8 bytes if the vocabulary has byte pieces.

The vocabulary is read from a tokenizer file whose path is a parameter, and broadcast: its size is that of the file.

Defined results: null and empty texts have 0 tokens; very long texts are counted word by word; a word of any
length is counted with as many positions in memory as the longest piece has; repeated rows get repeated results.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, slices, text_of

VOCABULARY = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Shift of the rank-frequency rule.
RANK_SHIFT = 100.0
#: Characters of a word whose count is remembered; longer ones are counted anew, in constant memory.
CACHED_CHARS = 64
_CACHE = 400_000


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that stand for text with their log probabilities, in id order, and whether bytes stand for unknown characters.

    Control, unknown and byte pieces never match text. The scores of a merge vocabulary are negative ranks, not log
    probabilities; by the rank-frequency rule a piece of rank r gets -log(r + RANK_SHIFT). Scores of other files are kept.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    scores = [p.get_score(i) for i in plain]
    if scores and all(s <= 0 and s == int(s) for s in scores):
        scores = [-math.log(RANK_SHIFT - s) for s in scores]
    return [(p.id_to_piece(i), s) for i, s in zip(plain, scores, strict=True)], any(p.is_byte(i) for i in range(p.get_piece_size()))


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        self.longest = 1
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                self.longest = max(self.longest, len(piece))
        self.automaton.make_automaton()
        self.bytes = byte_fallback
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path of one word, its space mark included; only as many positions as the longest piece are kept."""
        ring = self.longest + 1
        best, pieces, unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        ahead = next(matches, None)
        for end in range(1, len(word) + 1):
            here = []
            while ahead is not None and ahead[0] == end - 1:
                here.append(ahead[1])
                ahead = next(matches, None)
            here.sort(reverse=True)  # longest first: the earlier start
            top, count, alone, single = None, 0, False, False
            for size, score in here:
                single = single or size == 1
                at = (end - size) % ring
                got = score + best[at]
                if top is None or got > top:
                    top, count, alone = got, pieces[at] + 1, False
            if not single:
                at = (end - 1) % ring
                got = self.unknown + best[at]
                if top is None or got > top:
                    if self.bytes:
                        count = pieces[at] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                    else:  # unknown characters in a row are one token
                        count = pieces[at] + (not unknown[at])
                    top, alone = got, True
            best[end % ring], pieces[end % ring], unknown[end % ring] = top, count, alone
        return pieces[len(word) % ring]

    def text(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ")
        if not parts[0]:
            parts = parts[1:]  # it starts with a space, so no mark is put before it
        cache = self.cache
        new = {w for w in parts if w not in cache and len(w) <= CACHED_CHARS}
        if new:
            if len(cache) + len(new) > _CACHE:
                cache.clear()
                new = {w for w in parts if len(w) <= CACHED_CHARS}
            for w in new:
                cache[w] = self.word(MARK + w)
        return sum(cache[w] if len(w) <= CACHED_CHARS else self.word(MARK + w) for w in parts)


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*vocabulary.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([counter.text(t) for t in text_of(part).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
