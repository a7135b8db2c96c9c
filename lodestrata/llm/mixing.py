"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources get target word counts by weight, each capped at `cap` times its size, the excess reshared.
Documents of a source are dealt to about sqrt(n) blocks by hash; a source's blocks are drawn whole in
a permuted order, again from the start when it repeats, until its target is inside a block. Of that
boundary block, and of those around it up to EDGE_DOCS documents, those that still fit are taken,
and the last of them exchanged for the best subset, so the words taken end near the target. The blocks to draw of each source are exact quotas: a binary tree over the output
shards splits them, each node drawing its left half from a multivariate hypergeometric distribution.
Each shard then takes the next blocks of every source's permutation, disjoint from other shards', and is
shuffled locally by hash.

The driver holds one row per source and the sources x shards quotas; more than MAX_SOURCES sources raise
ValueError. Blocks, about the root of the documents, stay distributed.

Defined results: null text has size 0; the null source is a source, last in order; equal rows are taken
together; sources of size 0 take nothing; an empty table gives an empty result; reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, in_arrow, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 17
MAX_SOURCES = 100_000
#: Words in an output shard, about 60 MB of text; at least MIN_SHARDS shards.
SHARD_WORDS = 10_000_000
MIN_SHARDS = 8
#: Documents at a source's boundary from which the last words are filled.
EDGE_DOCS = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_size(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def target_words(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of the total by weight; none above cap times its size, the excess reshared by weight among the rest."""
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = cap * float(sizes[i])
            left -= out[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources draws that sum to the quotas; shards' sizes differ by one at most per level."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        low, high, q = stack.pop()
        if high - low == 1:
            out[low] = q
            continue
        mid = (low + high) // 2
        n = int(q.sum()) * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        stack += [(low, mid, left), (mid, high, q - left)]
    return out


def fill(sizes: np.ndarray, rows: np.ndarray, room: float) -> np.ndarray:
    """Which entries to take so that their words come near the room: in order whatever fits, then the best exchange.

    The exchange reconsiders the last ten taken and the first fourteen left by an exact subset sum.
    """
    take = np.zeros(len(sizes), bool)
    total = (sizes * rows).astype(np.int64)
    left = room
    for i in range(len(sizes)):
        if total[i] <= left:
            take[i] = True
            left -= total[i]
    items = np.concatenate([np.flatnonzero(take)[-10:], np.flatnonzero(~take)[:14]])
    if len(items):
        want = round(left + total[items[take[items]]].sum())
        take[items] = nearest_subset(total[items], want)
    return take


def nearest_subset(sizes: np.ndarray, want: int) -> np.ndarray:
    """Which of up to about thirty sizes sum nearest to the wanted one, exactly: each half's subset sums meet in the middle.

    Time and memory follow the number of sizes, not their magnitude. Of equally near sums the lesser is taken.
    """

    def sums(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for x in part:
            out = np.concatenate([out, out + int(x)])  # bit i of an index: entry i is in
        return out

    half = len(sizes) // 2
    low, high = sums(sizes[:half]), sums(sizes[half:])
    order = np.argsort(low, kind="stable")
    at = np.searchsorted(low[order], want - high)
    best = None
    for slot in (np.maximum(at - 1, 0), np.minimum(at, len(low) - 1)):
        got = low[order[slot]] + high
        k = int(np.lexsort((got, np.abs(got - want)))[0])
        found = (abs(int(got[k]) - want), int(got[k]), int(order[slot[k]]), k)
        best = min(best, found) if best else found
    bits = best[2] | best[3] << half
    return np.array([bits >> i & 1 == 1 for i in range(len(sizes))], bool)


class Mix:
    """The plan of a mix over stored sizes; see documents() and rows()."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.docs, self.seed, self.cols = docs, seed, (id_col, text_col, source_col)
        spark = docs.sparkSession
        self.sizes = stored(self._sized(docs).select("doc_id", "source", "size", "h"), "sizes")
        found = self.sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        words = [r["size"] for r in found]
        targets = target_words(words, [weights[i % len(weights)] for i in range(len(found))], share * sum(words), cap)
        plan = []
        for i, (r, t) in enumerate(zip(found, targets, strict=True)):
            full = min(int(t // r["size"]), int(cap)) if r["size"] else 0
            plan.append((i, r["source"], r["size"], t, full, t - full * r["size"], math.isqrt(max(0, r["n"] - 1)) + 1))
        self.plan = spark.createDataFrame(plan, f"sid int, source {docs.schema[source_col].dataType.simpleString()}, source_size bigint, target double, full int, rest double, n_blocks int")
        self.blocks = stored(self._blocks(), "blocks")
        self.n_blocks = sum(p[6] for p in plan)
        self.shards = shards or max(MIN_SHARDS, -(-int(share * sum(words)) // SHARD_WORDS))
        self.picks = stored(self._picks(), "picks")

    def _sized(self, docs: DataFrame) -> DataFrame:
        i, t, s = self.cols
        sized = docs.select(F.col(i).alias("doc_id"), F.col(s).alias("source"), word_size(t).alias("size"))
        return sized.withColumn("h", F.xxhash64(F.lit(self.seed), "doc_id", "source", "size"))

    def _placed(self, sized: DataFrame, source: str = "source", h: str = "h") -> DataFrame:
        plan = F.broadcast(self.plan.withColumnRenamed("source", "plan_source"))
        return sized.join(plan, sized[source].eqNullSafe(plan["plan_source"]), "left").drop("plan_source").withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed + 1), h), F.col("n_blocks")).cast("int"))

    def _blocks(self) -> DataFrame:
        """sid, block, pos, full, n_blocks; whole: drawn once more; edge: words still to take from the blocks that have it, else null."""
        summed = self._placed(self.sizes).groupBy("sid", "block", "full", "rest", "n_blocks").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(self.seed + 2), "sid", "block"), "block")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        placed = summed.withColumn("pos", F.row_number().over(order) - 1).withColumn("cum", F.sum("words").over(upto)).withColumn("cum_docs", F.sum("docs").over(upto))
        whole = F.col("cum") <= F.col("rest")
        before = F.when((~whole) & (F.col("cum") - F.col("words") < F.col("rest")), F.col("cum_docs") - F.col("docs"))
        of_source = Window.partitionBy("sid")
        placed = placed.withColumn("crossed", F.max(before).over(of_source))
        edge = F.coalesce((F.col("cum_docs") > F.col("crossed") - EDGE_DOCS // 2) & (F.col("cum_docs") - F.col("docs") < F.col("crossed") + EDGE_DOCS), F.lit(False))
        placed = placed.withColumn("on_edge", edge).withColumn("done", F.min(F.when(F.col("on_edge"), F.col("cum") - F.col("words"))).over(of_source))
        return placed.select("sid", "block", "pos", "full", "n_blocks", (whole & ~F.col("on_edge")).alias("whole"), F.when(F.col("on_edge"), F.col("rest") - F.col("done")).alias("edge"))

    def _picks(self) -> DataFrame:
        """sid, block, h of the documents taken at the boundary: about the root of a source's documents, EDGE_DOCS at least."""

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["pos", "h"])
            return pdf[fill(pdf["size"].to_numpy(float), pdf["rows"].to_numpy(float), float(pdf["edge"].iloc[0]))][["sid", "block", "h"]]

        edges = self.blocks.where("edge is not null").select("sid", "block", "pos", "edge")
        inside = self._placed(self.sizes).select("sid", "block", "h", "size").join(F.broadcast(edges), ["sid", "block"])
        grouped = inside.groupBy("sid", "block", "pos", "h", "size", "edge").agg(F.count(F.lit(1)).alias("rows"))
        return grouped.groupBy("sid").applyInPandas(choose, "sid int, block int, h bigint")

    def _bounded(self, df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, copies, taken for every document."""
        # How often the splitting tree's shards draw each block, and whether one draws it for its picked documents only.
        drawn = self.draws().groupBy("sid", "block").agg(F.count_if(~F.col("edge")).cast("int").alias("draws"), F.max("edge").alias("edge"))
        with_block = self._placed(self.sizes).join(self._bounded(stored(drawn, "draws"), self.n_blocks), ["sid", "block"], "left")
        picked = self._bounded(self.picks.withColumn("picked", F.lit(1)).distinct(), self.n_blocks)
        out = with_block.join(picked, ["sid", "block", "h"], "left")
        copies = F.coalesce("draws", F.lit(0)) + F.when(F.col("edge") & F.col("picked").isNotNull(), 1).otherwise(0)
        return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

    def draws(self) -> DataFrame:
        """sid, block, copy, shard, edge: where each drawn block goes."""
        per_source = self.blocks.groupBy("sid").agg(F.sum(F.col("full") + F.when(F.col("whole") | F.col("edge").isNotNull(), 1).otherwise(0)).alias("n")).orderBy("sid").collect()
        quotas = np.array([r["n"] for r in per_source], np.int64)
        cuts = np.cumsum(split_quotas(quotas, self.shards, self.seed), axis=0) if len(quotas) else np.zeros((self.shards, 0), np.int64)
        cuts_of = self.docs.sparkSession.sparkContext.broadcast({r["sid"]: cuts[:, i].copy() for i, r in enumerate(per_source)})

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sid, block, pos, full, n_blocks, whole, edge = (c.to_pylist() for c in batch.columns)
                rows = []
                for k in range(batch.num_rows):
                    for copy in range(full[k] + bool(whole[k] or edge[k] is not None)):
                        shard = int(np.searchsorted(cuts_of.value[sid[k]], copy * n_blocks[k] + pos[k], "right"))
                        rows.append((sid[k], block[k], copy, shard, copy == full[k] and not whole[k]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], ["sid", "block", "copy", "shard", "edge"])

        return in_arrow(self.blocks, place, "sid int, block int, copy int, shard int, edge boolean")

    def rows(self, shard_col: str = "shard", copy_col: str = "copy") -> DataFrame:
        """The mixed rows with all columns of docs, and their shard and copy number, shuffled inside each shard."""
        i, t, s = self.cols
        sid, h, block, order = (fresh(self.docs, x) for x in ("ld_sid", "ld_h", "ld_block", "ld_order"))
        copy, shard = fresh(self.docs, copy_col), fresh(self.docs, shard_col)
        plan = F.broadcast(self.plan.select(F.col("sid").alias(sid), F.col("source").alias(fresh(self.docs, "ld_source")), F.col("n_blocks").alias(fresh(self.docs, "ld_n"))))
        src, n = plan.columns[1], plan.columns[2]
        placed = (
            self.docs.withColumn(h, F.xxhash64(F.lit(self.seed), i, s, word_size(t)))
            .join(plan, F.col(s).eqNullSafe(F.col(src)))
            .withColumn(block, F.pmod(F.xxhash64(F.lit(self.seed + 1), h), F.col(n)).cast("int"))
        )
        edge, picked = fresh(self.docs, "ld_edge"), fresh(self.docs, "ld_picked")
        draws = stored(self.draws(), "draws").select(F.col("sid").alias(sid), F.col("block").alias(block), F.col("copy").alias(copy), F.col("shard").alias(shard), F.col("edge").alias(edge))
        picks = self.picks.distinct().select(F.col("sid").alias(sid), F.col("block").alias(block), F.col("h").alias(h), F.lit(1).alias(picked))
        drawn = placed.join(self._bounded(draws, 2 * self.n_blocks), [sid, block]).join(self._bounded(picks, self.n_blocks), [sid, block, h], "left")
        drawn = drawn.where(~F.col(edge) | F.col(picked).isNotNull()).withColumn(order, F.xxhash64(F.lit(self.seed + 3), i, copy, h))
        return drawn.repartitionById(self.shards, F.col(shard)).sortWithinPartitions(shard, order, i).select(*self.docs.columns, shard, copy)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).rows()
