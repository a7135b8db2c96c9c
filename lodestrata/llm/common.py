"""Shared pieces of the text operators: scratch tables, bounded slices of Arrow text and numpy tokenising.

Texts are handled as UTF-8 bytes in numpy. A word is a maximal run of ASCII letters and digits and
non-ASCII bytes, compared after Unicode lower-casing. Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import SLICE_BYTES, byte_size, in_arrow  # noqa: F401
from ..scratch import discard, scratch_dir, settle  # noqa: F401
from ..scratch import store as stored

#: Rows up to which a list of keys is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x80:] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    WORD_BYTE[_a:_b] = True

_powers: dict[str, np.ndarray] = {}


# --------------------------------------------------------------------------- tables

def keyed_filter(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a list of keys that is already stored; broadcast only if its counted size is bounded."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, how)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2. Null ids count as learnt from, never as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(fraction, *columns: str):
    """True for about that fraction of rows, by a hash of the columns; the same rows in every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1_000_000)) < fraction * 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# --------------------------------------------------------------------------- Arrow text

def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about `limit` bytes of the text column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + limit, "right"))), start + 50_000, n)
            yield batch.slice(start, stop - start)
            start = stop


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and the n + 1 offsets of the texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return raw(pc.utf8_lower(texts))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; kept for texts of ordinary size."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        with np.errstate(over="ignore"):
            made = []
            for base in (_ODD, _ODD_INVERSE):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        if n > 4 * SLICE_BYTES:
            return made[0], made[1]
        _powers["up"], _powers["down"] = made
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with which span_hash gives the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((h[end] - h[start]) * powers(len(h))[1][start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (n + 1 entries)."""
    is_word = WORD_BYTE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = is_word[inner]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    before = inner[inner > 0] - 1
    last[before] = is_word[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words joined by one space, with a space after each text's last word."""
    is_word = WORD_BYTE[data]
    keep = is_word.copy()
    if len(data):
        keep[1:] |= is_word[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        keep[inner] = is_word[inner]
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return np.where(is_word, data, np.uint8(0x20))[keep], ends[offsets]
