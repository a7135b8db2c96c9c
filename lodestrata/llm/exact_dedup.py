"""Exact deduplication by a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; the document with the largest id stays.
Misra-Gries summaries of fixed size, one per partition, are merged into at most `counters` candidate
digests; a second count verifies them. The verified heavy digests, at most `counters` rows whatever
the input, are broadcast, so their losing rows are decided where they are read. All other rows, and
the heavy winners, shuffle by digest in the ordinary way.

Defined results: null text counts as empty; null ids sort below all others; of repeated rows that
share the winning id and text exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, in_arrow, stored

#: Counters of a summary. A digest on more than one row in `COUNTERS + 1` is surely found.
COUNTERS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: str = "text"):
    """Lowercase hex SHA-256 of the text after lower-casing A-Z; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).cast("binary"), 256)


def misra_gries(counts: Counter, k: int) -> Counter:
    """Keep k counters: subtract the (k + 1)-th largest count from all and drop what isn't positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - cut for x, n in counts.items() if n > cut})


def heavy_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them every one on more than rows / (counters + 1) rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            kept.update(batch.column(0).to_pylist())
            if len(kept) > 32 * counters:
                kept = misra_gries(kept, counters)
        kept = misra_gries(kept, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept.keys()), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])

    merged = in_arrow(digests.select("digest"), summarise, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    # Merging keeps the largest sums; what it would subtract from all doesn't change their order.
    return merged.orderBy(F.desc("n"), "digest").limit(counters)


def heavy_winners(base: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, keep_id, group_size of the verified heavy digests: exact counts, two rows at least."""
    candidates = heavy_candidates(base, counters)
    return (
        base.join(F.broadcast(candidates.select("digest")), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.unhex(text_digest(text_col)).alias("digest")), "digests")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = digests_of(docs, id_col, text_col)
    winners = stored(heavy_winners(base, counters), "heavy")
    split = base.join(F.broadcast(winners), "digest", "left")
    decided = split.where(F.col("group_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    rest = split.where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    group = Window.partitionBy("digest")
    ordinary = rest.select(
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.coalesce("group_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
        "digest",
    )
    return decided.select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest").unionByName(ordinary).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all columns of docs."""
    winners = stored(heavy_winners(digests_of(docs, id_col, text_col), counters), "heavy")
    digest, keep, rank = (fresh(docs, x) for x in ("ld_digest", "ld_keep", "ld_rank"))
    marked = docs.withColumn(digest, F.unhex(text_digest(text_col)))
    heavy = F.broadcast(winners.select(F.col("digest").alias(digest), F.struct("keep_id").alias(keep)))
    # Losing copies of heavy digests go here, before the shuffle that carries texts.
    rest = marked.join(heavy, digest, "left").where(F.col(keep).isNull() | F.col(id_col).eqNullSafe(F.col(f"{keep}.keep_id")))
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    return rest.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
