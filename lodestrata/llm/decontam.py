"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of a passage of length m with at most k edits shares at least m - q + 1 - k q q-grams
with it, all on k + 1 neighbouring diagonals. Rolling hashes of all q-grams of a document are looked
up in the benchmark's index; hits are counted in overlapping diagonal bands, bands that reach the
bound are kept, and a banded alignment counts the edits of each.

Both sides are compared as lower-case words joined by one space. k is `edit_rate` of the passage's
length, less where the bound would not be positive; passages shorter than q must occur verbatim as
whole words. The benchmark is taken in blocks of bounded size. One block is broadcast to one narrow pass. Of several,
each has a pass of its own, so a worker holds one block at a time; a pass returns only the texts with hits. Hits are
expanded and counted EXPAND at a time, so a q-gram of very many passages doesn't swell memory.

Defined results: null and empty texts are clean; null, empty and wordless passages match nothing;
repeated passages count once per item_id; ids of any type work; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_arrow, lowered, normalised, prefix_hash, slices, span_hash, stored, text_of

Q = 16
EDIT_RATE = 0.05
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Hits that are expanded at once.
EXPAND = 2_000_000
_BITS = 22


class Index:
    """q-grams of a block of passages; item and offset of each occurrence in CSR form."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edit_rate: float = EDIT_RATE):
        self.q = q
        data, offsets = normalised(*lowered(pa.array([t for _, t in items], pa.large_string())))
        cut = [bytes(data[a:b]).strip() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.passages = [x for x in cut if x]
        self.ids = [i for (i, _), x in zip(items, cut, strict=True) if x]
        self.length = np.array([len(x) for x in self.passages], np.int64)
        room = np.maximum(0, (self.length - q) // q)  # k q <= m - q keeps the bound at 1 or more
        self.budget = np.minimum((self.length * edit_rate).astype(np.int64), room)
        self.bound = self.length - q + 1 - self.budget * q
        self.short = [k for k, x in enumerate(self.passages) if len(x) < q]
        joined = np.frombuffer(b"".join(self.passages) or b" ", np.uint8)
        at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        counts = np.maximum(0, self.length - q + 1)
        item = np.repeat(np.arange(len(self.passages)), counts)
        off = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = at[item] + off if len(item) else np.zeros(0, np.int64)
        grams = span_hash(prefix_hash(joined), start, start + q)
        order = np.argsort(grams, kind="stable")
        self.grams, first, n = np.unique(grams[order], return_index=True, return_counts=True)
        self.first, self.n, self.item, self.off = (x.astype(np.uint32) for x in (first, n, item[order], off[order]))
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True


def edits(passage: bytes, window: bytes, budget: int) -> int:
    """Least edits to find the passage inside the window, or budget + 1; a free start and end in the window.

    Each row of the dynamic programme is a vector over the window's columns: the region handed over is
    already cut to its diagonal band, so the vector is the band.
    """
    if passage in window:
        return 0
    if not window:
        return min(len(passage), budget + 1)
    w = np.frombuffer(window, np.uint8)
    steps = np.arange(len(w) + 1)
    row = np.zeros(len(w) + 1, np.int64)
    for i, c in enumerate(passage, 1):
        best = np.empty(len(w) + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (w != c), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > budget:
            return budget + 1
    return min(int(row.min()), budget + 1)


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of keys with the sums of n."""
    if not keys.shape[1]:
        return keys, n
    order = np.lexsort(keys[::-1])
    keys, n = keys[:, order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0).any(axis=0)]))
    return keys[:, new], np.add.reduceat(n, new)


def band_hits(index: Index, at: np.ndarray, slot: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, passage, band) of every hit and how many hits each has; at, slot, row: where a known q-gram starts."""
    keys, count = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
    upto = np.cumsum(index.n[slot].astype(np.int64))
    low = 0
    while low < len(slot):
        # As many starts as expand to EXPAND hits, one at least.
        done = int(upto[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + EXPAND, "right")))
        n = index.n[slot[low:high]].astype(np.int64)
        which = np.repeat(index.first[slot[low:high]].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, off = index.item[which].astype(np.int64), index.off[which].astype(np.int64)
        owner, pos = np.repeat(row[low:high], n), np.repeat(at[low:high], n)
        diagonal = pos - offsets[owner] - off + index.length[item]  # never negative
        band = diagonal // (index.budget[item] + 1)
        # Bands of two widths that overlap by one: any k + 1 neighbouring diagonals lie in one of them.
        found = np.concatenate([np.stack([owner, item, band]), np.stack([owner, item, band - 1])], axis=1)
        keys, count = counted(np.concatenate([keys, found], axis=1), np.concatenate([count, np.ones(found.shape[1], np.int64)]))
        low = high
    return keys, count


def matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> dict[int, dict[int, int]]:
    """Row -> passage -> least edits, over normalised texts."""
    q, found = index.q, {}
    if len(index.grams) and len(data) >= q:
        h = prefix_hash(data)
        at = np.arange(len(data) - q + 1)
        grams = span_hash(h, at, at + q)
        at = at[index.table[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]]
        grams = grams[at]
        slot = np.searchsorted(index.grams, grams)
        slot[slot == len(index.grams)] = 0
        real = index.grams[slot] == grams
        at, slot = at[real], slot[real]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + q <= offsets[row + 1]
        at, slot, row = at[inside], slot[inside], row[inside]
        keys, count = band_hits(index, at, slot, row, offsets)
        if keys.shape[1]:
            good = count >= index.bound[keys[1]]
            for r, i, b in keys[:, good].T.tolist():
                if found.get(r, {}).get(i, 1) == 0:
                    continue
                size, w, k = int(index.length[i]), int(index.budget[i]) + 1, int(index.budget[i])
                begin, stop = int(offsets[r]), int(offsets[r + 1])
                low = begin + max(0, b * w - size - k)
                high = min(stop, begin + (b + 2) * w + k)
                got = edits(index.passages[i], data[low:high].tobytes(), k)
                if got <= k:
                    found.setdefault(r, {})[i] = min(got, found.get(r, {}).get(i, got))
    for k in index.short:
        needle = b" " + index.passages[k] + b" "
        for r in range(len(offsets) - 1):
            if needle in b" " + data[offsets[r] : offsets[r + 1]].tobytes() + b" ":
                found.setdefault(r, {})[k] = 0
    return found


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The benchmark's passages in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items for b in range(n)]


def broadcast_index(block: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE):
    rows = sorted({(r["item_id"], r["text"]) for r in block.collect()}, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1]))
    return block.sparkSession.sparkContext.broadcast(Index(rows, q, edit_rate))


def _found(part: pa.RecordBatch, index) -> list[dict]:
    """Of each row: item id -> least edits."""
    data, offsets = normalised(*lowered(text_of(part)))
    rows: list[dict] = [{} for _ in range(part.num_rows)]
    for r, hit in matches(index.value, data, offsets).items():
        for i, k in hit.items():
            item = index.value.ids[i]
            rows[r][item] = min(k, rows[r].get(item, k))
    return rows


RESULT = ["contaminated", "n_items", "min_edits", "item_ids"]


def _ordered(items) -> list:
    return sorted(items, key=lambda i: (i is None, 0 if i is None else i))


def _one_block(docs: DataFrame, index, id_type) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, min_edits, item_ids."""
    arrow_ids = pa.list_(to_arrow_type(id_type))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, contaminated boolean, n_items bigint, min_edits bigint, item_ids array<{id_type.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = _found(part, index)
            columns = [pa.array([bool(x) for x in rows], pa.bool_()), pa.array([len(x) for x in rows], pa.int64()), pa.array([min(x.values()) if x else None for x in rows], pa.int64()), pa.array([_ordered(x) for x in rows], arrow_ids)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *RESULT])

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def _hits(docs: DataFrame, blocks: list[DataFrame], id_type, q: int, edit_rate: float) -> DataFrame:
    """Stored id, digest, item_id, edits of the texts that a passage of some block is in, a pass over the documents for each block."""
    arrow_id = to_arrow_type(id_type)
    schema = f"id {docs.schema['doc_id'].dataType.simpleString()}, digest string, item_id {id_type.simpleString()}, edits bigint"
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("digest"))
    out = None
    for block in blocks:
        index = broadcast_index(block, q, edit_rate)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = [(r, i, k) for r, x in enumerate(_found(part, index)) for i, k in x.items()]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array([f[1] for f in found], arrow_id), pa.array([f[2] for f in found], pa.int64())], ["id", "digest", "item_id", "edits"])

        hits = stored(in_arrow(keyed, run, schema), "hits")
        index.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, min_edits (null if clean), item_ids (sorted)."""
    blocks, id_type = blocks_of(benchmark), benchmark.schema["item_id"].dataType
    if len(blocks) == 1:
        return _one_block(docs, broadcast_index(blocks[0], q, edit_rate), id_type)
    hits = _hits(docs, blocks, id_type, q, edit_rate).groupBy("id", "digest", "item_id").agg(F.min("edits").alias("edits"))
    per = hits.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n_items"), F.min("edits").alias("min_edits"), F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("last"), "item_id"))).alias("items"))
    keyed = docs.select("doc_id", F.md5("text").alias("own"))
    joined = keyed.join(per, keyed["doc_id"].eqNullSafe(per["id"]) & (keyed["own"] == per["digest"]), "left")
    ids = F.coalesce(F.transform("items", lambda x: x["item_id"]), F.array().cast(f"array<{id_type.simpleString()}>"))
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "min_edits", ids.alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The clean documents with all their columns; of one block of passages in one narrow pass."""
    blocks = blocks_of(benchmark)
    if len(blocks) > 1:
        hits = _hits(docs, blocks, benchmark.schema["item_id"].dataType, q, edit_rate).select("id", "digest").distinct()
        return docs.join(hits, docs["doc_id"].eqNullSafe(hits["id"]) & (F.md5(docs["text"]) == hits["digest"]), "left_anti")
    index = broadcast_index(blocks[0], q, edit_rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([not x for x in _found(part, index)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
