"""MinHash near-deduplication: improved consistent weighted sampling over TF-IDF word shingles.

A document is its multiset of shingles of five lower-case words (all its words as one shingle, if it has
fewer), each weighing term frequency times inverse document frequency. SAMPLES consistent weighted
samples are taken, ROWS of them make a band, and documents that share a band are candidates. Candidates
are verified by their exact weighted Jaccard similarity, and the links' connected components are the
classes; the smallest id of a class stays.

Inverse document frequency is ln(N / df) / ln(1 / FREQUENT), at most 1 and at least 0.05: a shingle in
fewer than a twentieth of the documents weighs 1, so only a bounded list of frequent shingles (at most
the mean shingle count / FREQUENT) has other weights. df and N count distinct word sequences of the whole corpus,
exactly: partitions name the buckets of shingle hashes that can hold a frequent one, without losing any, and a second
pass counts the shingles of those buckets. So df doesn't depend on how rows are dealt, and exact copies count once.
In df, texts that consist of frequent shingles by SIMILARITY or more and share the least of them count once too, so a
large group of near copies doesn't make its own text look like a common phrase; texts that share less all count.

Equal word sequences are collapsed before banding. In each band bucket, every text is compared with up to
five hubs, not with all others: the pairs grow in proportion to the bucket. Components join what hubs of
different bands link. What hubs leave is found exactly: among the texts of buckets that still hold several
classes, a prefix filter gives every pair of different classes that can reach the threshold. So no similar pair
that shares a bucket ends in two classes. The filter's bound is that of each pair, from both total weights. ROUNDS of
one partner for each text and shingle merge classes first; then texts that can't meet the bound on a shingle
with any text of another class leave, and the pairs of the rest are formed. Pairs whose total weights differ by more than the threshold allows
are left out unseen, as their similarity can't reach it.

Defined results: null and wordless texts and null ids are classes of their own; repeated rows share a class;
rows of one id are kept or dropped together; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, keyed_filter, lowered, mixed, normalised, prefix_hash, settle, slices, span_hash, stored, text_of, word_spans
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: 8 bands of 2 samples find a pair of similarity 0.8 with probability 0.9997.
SAMPLES, ROWS = 16, 2
FREQUENT = 0.05
LEAST_WEIGHT = 0.05
#: The frequent list's largest size; a longer list raises.
FREQUENT_ROWS = 1_000_000
#: Bits of a shingle hash that tell its bucket while frequent shingles are looked for.
BUCKET_BITS = 20
#: Rounds of one partner for each text and shingle, before all pairs of the exact search.
ROUNDS = 2
#: Distinct shingles that are counted in a task before their counts move on.
FLUSH = 1_000_000
#: Members of a bucket that meet its hubs in one task.
DEAL = 256
#: Shingles of an Arrow batch of the exact search.
CHUNK = 100_000
#: What rounding may take from a bound.
SLACK = 1e-5

_LOW16, _U16, _U32, _U48 = np.uint64(0xFFFF), np.uint64(16), np.uint64(32), np.uint64(48)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms at 65536 even steps."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.full(65536, 1.7)
    for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_made: list = []


def gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _made:
        _made.extend(_tables())
    return _made[0], _made[1]


def content_hash(data: np.ndarray, offsets: np.ndarray, i: int) -> bytes:
    return hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes().strip(), digest_size=16).digest()


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48 - BUCKET_BITS)).astype(np.int64)


class Shingles:
    """Distinct shingles of each text of a slice: 48-bit hash, count, and where each text's begin."""

    def __init__(self, texts: pa.Array, words: int = WORDS):
        self.data, self.offsets = normalised(*lowered(texts))
        starts, ends, first = word_spans(self.data, self.offsets)
        h = prefix_hash(self.data)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, (n > 0).astype(np.int64)))
        within = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
        begin = first[doc] + within
        stop = np.minimum(begin + words, first[doc + 1]) - 1
        # Words are joined by single spaces, so the hash of a shingle is that of its span.
        key = (doc.astype(np.uint64) << _U48) | (span_hash(h, starts[begin], ends[stop]) >> _U16)
        key.sort()
        if len(key):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.count = np.diff(np.append(new, len(key))).astype(np.float32)
            key = key[new]
        else:
            self.count = np.zeros(0, np.float32)
        self.doc = (key >> _U48).astype(np.int64)
        self.hash = key & np.uint64((1 << 48) - 1)
        self.at = np.searchsorted(self.doc, np.arange(len(n) + 1))
        self.filled = np.flatnonzero(np.diff(self.at))

    def content(self, i: int) -> bytes:
        """Hash of the sequence of words of text i."""
        return content_hash(self.data, self.offsets, i)


class Weights:
    """Inverse document frequencies: 1 but for the listed shingles."""

    def __init__(self, shingles: np.ndarray, weights: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.weights = shingles[order].astype(np.uint64), weights[order].astype(np.float32)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.shingles >> np.uint64(28)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), np.float32)
        if len(self.shingles):
            at = np.flatnonzero(self.table[(hashes >> np.uint64(28)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
            hit = self.shingles[slot] == hashes[at]
            out[at[hit]] = self.weights[slot[hit]]
        return out


def weighted_samples(s: Shingles, weight: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A sample hash for each filled text and sample number: the shingle and level that the scheme selects."""
    gamma, log_gamma = gamma_tables()
    log_weight = np.log(weight)
    begin, size = s.at[s.filled], np.diff(s.at)[s.filled]
    owner = np.repeat(np.arange(len(s.filled)), size)
    out = np.empty((len(s.filled), samples), np.uint64)
    for i in range(samples):
        x = mixed(s.hash + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = gamma[(x & _LOW16).astype(np.int64)]
        beta = ((x >> _U32) & _LOW16).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + beta)
        a = log_gamma[((x >> _U16) & _LOW16).astype(np.int64)] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == least[owner])
        hit = hit[np.searchsorted(owner[hit], np.arange(len(begin)), "left")]
        out[:, i] = mixed(s.hash[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) << _U48))
    return out


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = []
    for b in range(0, samples.shape[1], rows):
        key = np.full(len(samples), b + 1, np.uint64)
        for j in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, b + j])
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def contents_of(docs: DataFrame) -> DataFrame:
    """content, rows: the distinct word sequences and on how many rows each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = normalised(*lowered(text_of(part)))
            found = [content_hash(data, offsets, i) for i in np.flatnonzero(np.diff(offsets)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["content"])

    return in_arrow(docs.select("text"), run, "content binary").groupBy("content").agg(F.count(F.lit(1)).alias("rows"))


def frequent_buckets(docs: DataFrame, least: float, words: int = WORDS) -> np.ndarray:
    """Whether a bucket of shingle hashes (their first BUCKET_BITS bits) holds `least` of the rows of some partition.

    A shingle on `least` of all rows is on as large a share of the rows of one partition at least, and its bucket counts no fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for part in slices(batches):
            s = Shingles(text_of(part), words)
            held += np.bincount(bucket(s.hash), minlength=len(held))
            n += len(s.filled)
        found = np.flatnonzero((held > 0) & (held >= least * n * (1 - 1e-9)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bucket"])

    out = np.zeros(1 << BUCKET_BITS, bool)
    out[in_arrow(docs.select("text"), run, "bucket bigint").distinct().toPandas()["bucket"].to_numpy(np.int64)] = True
    return out


def bucket_shingles(docs: DataFrame, buckets: np.ndarray, words: int = WORDS) -> DataFrame:
    """content, size, shingles: the distinct contents with a shingle in the given buckets, how many shingles each has, and those."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.unpackbits(wanted.value).astype(bool), set()
        for part in slices(batches):
            s = Shingles(text_of(part), words)
            hit = np.flatnonzero(table[bucket(s.hash)])
            doc, shingle = s.doc[hit], s.hash[hit].view(np.int64)
            rows = []
            for i in np.unique(doc).tolist():
                content = s.content(i)
                if content not in seen:
                    seen.add(content)
                    rows.append((content, int(s.at[i + 1] - s.at[i]), shingle[np.searchsorted(doc, i) : np.searchsorted(doc, i, "right")]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["content", "size", "shingles"])

    found = in_arrow(docs.select("text"), run, "content binary, size bigint, shingles array<bigint>")
    return found.groupBy("content").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))


def frequent_counts(lists: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles on `least` of the (content, size, shingles) rows, and on how many each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(own), FLUSH):
                shingles, back = np.unique(np.concatenate([held, own[at : at + FLUSH]]), return_inverse=True)
                held_n = np.bincount(back, np.concatenate([held_n, np.ones(len(back) - len(held_n), np.int64)]), len(shingles)).astype(np.int64)
                held = shingles
                if len(held) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(held_n)], ["shingle", "n"])
                    held, held_n = held[:0], held_n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(held_n)], ["shingle", "n"])

    counts = in_arrow(lists.select("shingles"), run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    listed = stored(counts.where(F.col("n") >= least), "df")
    if listed.count() > FREQUENT_ROWS:
        raise ValueError(f"more than {FREQUENT_ROWS} frequent shingles")
    found = listed.toPandas()
    return found["shingle"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def copies_once(lists: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The rows of lists, but one of those that consist of frequent shingles by SIMILARITY and share the least of them."""
    known = lists.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], []
            for i in range(batch.num_rows):
                own = batch["shingles"][i].values.to_numpy()
                own = own[np.isin(own, known.value, kind="sort")]
                like = len(own) >= SIMILARITY * batch["size"][i].as_py()
                keys.append(int(mixed(own.view(np.uint64)).min()).to_bytes(8, "big") if like else batch["content"][i].as_py())
                kept.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch["content"], pa.array(kept, pa.list_(pa.int64()))], ["key", "content", "shingles"])

    keyed = in_arrow(lists.select("content", "size", "shingles"), run, "key binary, content binary, shingles array<bigint>")
    return keyed.groupBy("key").agg(F.min(F.struct("content", "shingles"))["shingles"].alias("shingles"))


def frequent_weights(docs: DataFrame, words: int = WORDS, share: float = FREQUENT) -> Weights:
    """Weights of the shingles on at least `share` of all distinct contents."""
    sums = contents_of(docs).agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).first()
    total = sums["n"]
    if not total:
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    # `share` of the contents is on this share of the rows at least.
    lists = stored(bucket_shingles(docs, frequent_buckets(docs, share * total / sums["rows"], words), words), "frequent")
    least = max(2, share * total)
    found, df = frequent_counts(lists, least)
    if len(found):
        found, df = frequent_counts(copies_once(lists, found), least)
    discard(lists)
    weight = np.clip(np.log(np.maximum(total / np.maximum(df, 1), 1)) / np.log(1 / share), LEAST_WEIGHT, 1)
    return Weights(found.view(np.uint64), weight)


def signatures(docs: DataFrame, weights, words: int = WORDS, samples: int = SAMPLES, rows: int = ROWS) -> DataFrame:
    """doc_id, content (null if wordless), bands."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = Shingles(text_of(part), words)
            contents: list = [None] * part.num_rows
            bands: list = [None] * part.num_rows
            if len(s.filled):
                keys = band_keys(weighted_samples(s, s.count * weights.value.of(s.hash), samples), rows)
                for i, key in zip(s.filled.tolist(), keys.tolist(), strict=True):
                    contents[i], bands[i] = s.content(i), key
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "content", "bands"])

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def weighted_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima; keys are sorted and distinct."""
    slot = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[slot] == ka
    least = float(np.minimum(wa[hit], wb[slot[hit]]).sum(dtype=np.float64))
    return least / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - least)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """band, key, content, n, members of the buckets with two texts or more."""
    entries = nodes.select("content", "n", F.posexplode("bands").alias("band", "key"))
    sizes = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return stored(entries.join(sizes, ["band", "key"]), "buckets")


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs a < b of contents: each member of a band bucket with the bucket's hubs.

    Hubs are the most popular member (whose buckets hold most members, then the one on most rows: in a group of copies,
    often what they were copied from) and the extremes of the content hash and of a second hash, five at most. Up to six members, that is every pair.
    """
    popular = shared.groupBy("content").agg(F.struct(F.sum("members").alias("members"), F.max("n").alias("n")).alias("popularity"))
    other = F.xxhash64("content")
    hubs = shared.join(popular, "content").groupBy("band", "key").agg(
        F.max(F.struct("popularity", "content"))["content"].alias("p"),
        F.min("content").alias("low"),
        F.max("content").alias("high"),
        F.min(F.struct(other.alias("h"), "content"))["content"].alias("low2"),
        F.max(F.struct(other.alias("h"), "content"))["content"].alias("high2"),
        F.first("members").alias("members"),
    )
    # A large bucket is dealt to several tasks, and its hubs go to each of them.
    dealt = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("members") / DEAL).cast("int")))).drop("members")
    part = F.pmod(F.xxhash64("content"), F.floor(F.col("members") / DEAL) + 1).cast("int")
    joined = shared.select("band", "key", "content", part.alias("part")).join(dealt, ["band", "key", "part"])
    met = joined.select("content", F.explode(F.array_distinct(F.array("p", "low", "high", "low2", "high2"))).alias("hub")).where("content <> hub")
    return met.select(F.least("content", "hub").alias("a"), F.greatest("content", "hub").alias("b")).distinct()


def classed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """band, key, content, label; a content without a link is its own class."""
    placed = shared.select("band", "key", "content").join(labels.withColumnRenamed("node", "content"), "content", "left")
    return placed.withColumn("label", F.coalesce("label", "content"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, weights, words: int = WORDS) -> DataFrame:
    """content, keys, weights (packed uint32 and float32), total weight of the wanted (doc_id, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = Shingles(text_of(part), words)
            weight = s.count * weights.value.of(s.hash)
            short = (s.hash >> _U16).astype(np.uint32)
            content = part.column(1).to_pylist()
            rows = []
            for i in s.filled.tolist():
                if s.content(i) != content[i]:
                    continue  # another row of the same id
                a, b = s.at[i], s.at[i + 1]
                key, w = short[a:b], weight[a:b]
                if (key[1:] == key[:-1]).any():
                    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    key, w = key[new], np.add.reduceat(w, new)
                rows.append((content[i], key.tobytes(), w.astype(np.float32).tobytes(), float(w.sum(dtype=np.float64))))
            packed = [pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*packed, pa.array([r[3] for r in rows], pa.float64())], ["content", "keys", "weights", "total"])

    count = wanted.count()
    from .common import BROADCAST_ROWS

    small = F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted
    return in_arrow(docs.select("doc_id", "text").join(small, "doc_id").select("doc_id", "content", "text"), run, "content binary, keys binary, weights binary, total double")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold; sets move only for pairs whose totals allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, ka, wa, kb, wb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                j = weighted_jaccard(np.frombuffer(ka, np.uint32), np.frombuffer(wa, np.float32), np.frombuffer(kb, np.uint32), np.frombuffer(wb, np.float32))
                if j >= threshold - 1e-6:
                    kept.append((a, b, j))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.binary()), pa.array([r[1] for r in kept], pa.binary()), pa.array([r[2] for r in kept], pa.float64())], ["a", "b", "similarity"])

    side = lambda x: sets.select(F.col("content").alias(x), F.col("keys").alias(f"k{x}"), F.col("weights").alias(f"w{x}"))
    total = lambda x: sets.select(F.col("content").alias(x), F.col("total").alias(f"t{x}"))
    near = F.least("ta", "tb") >= (threshold - 1e-5) * F.greatest("ta", "tb")
    sized = pairs.join(total("a"), "a").join(total("b"), "b").where(near).select("a", "b")
    rows = sized.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "wa", "kb", "wb")
    return in_arrow(rows, run, "a binary, b binary, similarity double")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content, label, total, shingle, weight: a row for each shingle of packed sets."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = np.frombuffer(batch["keys"][i].as_py(), np.uint32).astype(np.int64)
            weights = np.frombuffer(batch["weights"][i].as_py(), np.float32)
            for at in range(0, len(keys), CHUNK):
                part = keys[at : at + CHUNK]
                own = [pa.repeat(batch[c][i], len(part)) for c in ("content", "label", "total")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part), pa.array(weights[at : at + CHUNK])], ["content", "label", "total", "shingle", "weight"])


def mixed_rows(shared: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored content, label, total, shingle, weight of the texts in buckets of several classes."""
    placed = classed_buckets(shared, labels)
    buckets = placed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "key")
    texts = stored(placed.join(buckets, ["band", "key"]).select("content", "label").distinct(), "mixed")
    return stored(in_arrow(sets.join(texts, "content").select("content", "label", "keys", "weights", "total"), unpacked, "content binary, label binary, total double, shingle bigint, weight float"), "shingles")


def prefixes(rows: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Stored content, total, shingle, gap: on which shingles of (content, label, total, shingle, weight) rows texts of two classes may meet.

    Shingles of several classes are put in one order, by falling frequency; `through` is a text's weight from the start of that order to
    a shingle. Texts of totals s and t that reach the threshold overlap in share * (s + t) at least, share = threshold / (1 + threshold), so
    the last shingle they have in common has a `through` of that or more in both. With gap = through - share * total that reads: either
    gap is share times the other's total at least. That holds for the classes of the rows and for any that they merge into.
    """
    share = threshold / (1 + threshold)
    crossing = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle", "df")
    order = Window.partitionBy("content").orderBy(F.desc("df"), "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = rows.join(crossing, "shingle").withColumn("through", F.sum(F.col("weight").cast("double")).over(order))
    gap = F.col("through") - share * F.col("total")
    # No total of a partner is below threshold times the own one.
    return stored(through.withColumn("gap", gap).where(F.col("gap") >= share * (threshold - SLACK) * F.col("total")).select("content", "total", "shingle", "gap"), "prefixes")


def labelled(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    named = prefix.join(labels.withColumnRenamed("node", "content"), "content", "left")
    return named.withColumn("label", F.coalesce("label", "content"))


def leading_pairs(prefix: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Distinct pairs a < b of different classes: each text with one other for each of its shingles.

    Among the texts of like totals on a shingle, that is the one of the greatest gap, which has most in common with the others; or, for the
    texts of its class, the one of the greatest gap in another class.
    """
    binned = prefix.withColumn("bin", F.floor(F.log("total") / float(-np.log(threshold))))
    lead = F.max(F.struct("gap", "total", "label", "content"))
    first = binned.groupBy("shingle", "bin").agg(lead.alias("first"))
    second = binned.join(first, ["shingle", "bin"]).where(F.col("label") != F.col("first.label")).groupBy("shingle", "bin").agg(lead.alias("second"))
    met = binned.join(first.join(second, ["shingle", "bin"]), ["shingle", "bin"])
    met = met.withColumn("other", F.when(F.col("label") == F.col("first.label"), F.col("second")).otherwise(F.col("first")))
    met = met.where(may_meet("total", "gap", "other.total", "other.gap", threshold))
    return met.select(F.least("content", "other.content").alias("a"), F.greatest("content", "other.content").alias("b")).distinct()


def may_meet(total: str, gap: str, other_total: str, other_gap: str, threshold: float):
    share = threshold / (1 + threshold)
    near = F.least(total, other_total) >= (threshold - SLACK) * F.greatest(total, other_total)
    return near & (F.col(gap) >= (share - SLACK) * F.col(other_total)) & (F.col(other_gap) >= (share - SLACK) * F.col(total))


def able(prefix: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows that some text of another class on the shingle may meet, by the largest gap and the least total of its other classes."""
    share = threshold / (1 + threshold)
    classes = prefix.groupBy("shingle", "label").agg(F.max("gap").alias("gap"), F.min("total").alias("total"))
    first = classes.groupBy("shingle").agg(F.max(F.struct("gap", "label")).alias("most"), F.min(F.struct("total", "label")).alias("least"))
    second = classes.join(first, "shingle").groupBy("shingle").agg(
        F.max(F.when(F.col("label") != F.col("most.label"), F.col("gap"))).alias("gap2"),
        F.min(F.when(F.col("label") != F.col("least.label"), F.col("total"))).alias("total2"),
    ).where("gap2 is not null")
    best = first.join(second, "shingle").select("shingle", F.col("most.gap").alias("gap1"), F.col("most.label").alias("gap_of"), "gap2", F.col("least.total").alias("total1"), F.col("least.label").alias("total_of"), "total2")
    other_gap = F.when(F.col("label") == F.col("gap_of"), F.col("gap2")).otherwise(F.col("gap1"))
    other_total = F.when(F.col("label") == F.col("total_of"), F.col("total2")).otherwise(F.col("total1"))
    meet = (F.col("gap") >= (share - SLACK) * other_total) & (other_gap >= (share - SLACK) * F.col("total"))
    return prefix.join(best, "shingle").where(meet).select("content", "label", "total", "shingle", "gap")


def remaining_pairs(prefix: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Distinct pairs a < b of different classes, every one that can reach the threshold."""
    rows = stored(able(prefix, threshold), "able")
    side = lambda x: rows.select("shingle", F.col("content").alias(x), F.col("label").alias(f"l{x}"), F.col("total").alias(f"t{x}"), F.col("gap").alias(f"g{x}"))
    meet = may_meet("ta", "ga", "tb", "gb", threshold)
    return side("a").join(side("b"), "shingle").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & meet).select("a", "b").distinct()


def exactly_linked(shared: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Labels after every pair of different classes in mixed buckets that reaches the threshold.

    ROUNDS of leading pairs come first: where hubs were badly chosen, classes merge by a number of pairs in proportion to the rows.
    What they leave, in classes that merged as far as they did, is found pair by pair.
    """
    rows = mixed_rows(shared, labels, sets)
    prefix = prefixes(rows, threshold)
    discard(rows)
    settle(prefix.sparkSession)
    for pairs in (*[leading_pairs] * ROUNDS, remaining_pairs):
        named = stored(labelled(prefix, labels), "labelled")
        links = stored(verified(pairs(named, threshold), sets, threshold), "links")
        discard(named)
        settle(prefix.sparkSession)
        if links.limit(1).count():
            labels = relabelled(labels, links)
    return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after further links; a content that had no label yet is its own."""
    named = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    labels = stored(labels.unionByName(named.withColumn("label", F.col("node"))), "labels")
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    merged = components(stored(between, "between"))
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return stored(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def near_labels(docs: DataFrame, words: int = WORDS, threshold: float = SIMILARITY, samples: int = SAMPLES, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored signatures, distinct contents (content, first_id, n) and the labels (node, label) of linked contents."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(frequent_weights(docs, words))
    settle(spark)
    signed = stored(signatures(docs, weights, words, samples, rows), "signatures")
    nodes = signed.where("content is not null and doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "contents")
    shared = shared_buckets(nodes)
    # Every text of a shared bucket meets a hub, so these sets serve both searches.
    wanted = stored(nodes.join(shared.select("content").distinct(), "content").select(F.col("first_id").alias("doc_id"), "content"), "wanted")
    sets = stored(shingle_sets(docs, wanted, weights, words), "sets")
    settle(spark)
    links = stored(verified(candidate_pairs(shared), sets, threshold), "links")
    settle(spark)
    labels = components(links)
    settle(spark)
    labels = exactly_linked(shared, labels, sets, threshold)
    return signed, nodes, labels


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), kept."""
    signed, nodes, labels = near_labels(docs, words, threshold)
    classed = nodes.select("content", "first_id").join(labels.withColumnRenamed("node", "content"), "content", "left").select("content", "first_id", F.coalesce("label", "content").alias("label"))
    least = classed.groupBy("label").agg(F.min("first_id").alias("class_id"))
    of = classed.join(least, "label").select("content", "class_id")
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("content")).alias("content")).join(of, "content", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all columns: ids none of whose rows is kept go."""
    classes = near_duplicate_classes(docs, words, threshold)
    dropped = stored(classes.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "dropped")
    return keyed_filter(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
