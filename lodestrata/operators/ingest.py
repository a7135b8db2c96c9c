"""Ingest, rebuild and reconstruct.

Ingest is a frontier loop: detect by header, unpack containers, hash children once, route. Content leaves the
plan as soon as it is hashed: tables below carry references only, and contents are a table of their own, written
once per distinct reference. A container that is already known is not unpacked again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import in_groups
from ..functions.formats import CRITERIA, detect
from ..functions.refs import entry_type, header, ref_key
from ..scratch import store
from ..sources.archives import WRITE, Child, unpack
from .catalog import REF, dedup_status, first_wins, insert_if_absent, last_non_null

ENTRIES = "container_key string, ordinal int, path string, key string, entry_type int, mtime bigint, mode int, format_metadata binary"


def with_ref(df: DataFrame, path: str, hasher=F.md5, criteria=CRITERIA) -> DataFrame:
    """Adds content_hash, leaf_size and the detected format; an empty directory counts as size 1."""
    size = F.when((F.octet_length("content") == 0) & F.col(path).endswith("/"), 1).otherwise(F.octet_length("content")).cast("bigint")
    return df.withColumn("content_hash", hasher(F.col("content"))).withColumn("leaf_size", size).withColumn("format", detect(F.lit(None).cast("string"), F.col(path), header(F.col("content")), criteria))


class Ingested:
    """Tables of one ingest: blobs (ref, mime), contents (key, content), containers (key, format, entry_count), entries."""

    def __init__(self, blobs: DataFrame, contents: DataFrame, containers: DataFrame, entries: DataFrame):
        self.blobs, self.contents, self.containers, self.entries = blobs, contents, containers, entries


def _named(df: DataFrame) -> DataFrame:
    """Adds key, container and opened: a file of tier 2 is opened too, but stays a leaf that its parent refers to."""
    opened = F.col("format.container") & (F.octet_length("content") > 0)
    return df.withColumn("opened", opened).withColumn("container", opened & (F.col("format.tier") < 2)).withColumn("key", ref_key(F.col("content_hash"), F.col("leaf_size"), F.col("container")))


def ingest(roots: DataFrame, max_depth: int = 16, hasher=F.md5, criteria=CRITERIA) -> Ingested:
    """roots(filename, content) -> Ingested. Nested containers re-enter until none is left or max_depth is passed.

    A container of tier 2 can't be rebuilt bit by bit: its original is kept as a leaf, and its parts are entries of that leaf's key.
    """
    spark = roots.sparkSession
    level = store(_named(with_ref(roots.select("filename", "content"), "filename", hasher, criteria)), "roots")
    blobs = [level.select("key", "content_hash", "leaf_size", "container", "format.mime_type")]
    contents = [level.select("key", "content", F.col("format.handler").alias("handler"), "container")]
    frontier = level.where("opened").select(F.col("key").alias("container_key"), "format.handler", "content").dropDuplicates(["container_key"])
    known, entries, depth = frontier.select("container_key", "handler"), [], 0
    while frontier.limit(1).count():
        depth += 1
        if depth > max_depth:
            raise ValueError(f"containers are nested deeper than {max_depth}")
        children = store(_named(with_ref(unpack(frontier), "path", hasher, criteria)), "children")
        entries.append(children.select("container_key", "ordinal", "path", "key", entry_type(F.col("path")).alias("entry_type"), "mtime", "mode", "format_metadata"))
        blobs.append(children.select("key", "content_hash", "leaf_size", "container", "format.mime_type"))
        contents.append(children.select("key", "content", F.col("format.handler").alias("handler"), "container"))
        inner = children.where("opened").select(F.col("key").alias("container_key"), F.col("format.handler").alias("handler"), "content").dropDuplicates(["container_key"])
        frontier = store(inner.join(known, "container_key", "left_anti"), "frontier")
        known = known.unionByName(frontier.select("container_key", "handler"))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    all_entries = union(entries) if entries else spark.createDataFrame([], ENTRIES)
    counted = all_entries.groupBy("container_key").agg(F.count(F.lit(1)).alias("entry_count"))
    containers = known.distinct().join(counted, "container_key", "left").select("container_key", F.col("handler").alias("format_key"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"))
    distinct_blobs = union(blobs).groupBy("key", "content_hash", "leaf_size", "container").agg(F.max("mime_type").alias("mime_type"))
    leaves = union(contents).where("not container").select("key", "content").dropDuplicates(["key"])
    return Ingested(distinct_blobs, leaves, store(containers, "containers"), store(first_wins(all_entries, ["container_key", "path"], "ordinal"), "entries"))


def ingest_into(index: Ingested, owned: DataFrame, roots: DataFrame, tenant: str, **options) -> tuple[Ingested, DataFrame, DataFrame]:
    """Ingest of a tenant's roots into an index that may hold them: the index after it, what tenants own, and the arrivals with their status.

    owned(tenant, key, content_hash, leaf_size, container) grows by what the tenant lacked. The status of an arrival is full_hit (the tenant
    has it), ref_hit (another has) or new. Contents are one table for all tenants, so a ref_hit adds no bytes, only a row of owned. A known
    reference takes the arriving MIME type where that isn't null; known containers and entries stay as they are.
    """
    done = ingest(roots, **options)
    arrived = done.blobs.withColumn("tenant", F.lit(tenant))
    status = store(dedup_status(arrived, owned), "status")
    gained = status.where("status <> 'full_hit'").select("tenant", "key", *REF)

    def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        return old.unionByName(insert_if_absent(old, new, keys))

    seen = index.blobs.withColumn("seq", F.lit(0)).unionByName(done.blobs.withColumn("seq", F.lit(1)))
    blobs = seen.groupBy("key", *REF).agg(last_non_null(F.col("mime_type"), F.col("seq")).alias("mime_type"))
    # Entries of a container belong together: those of a known one are not offered again.
    entries = index.entries.unionByName(done.entries.join(index.containers.select("container_key"), "container_key", "left_anti"))
    merged = Ingested(blobs, added(index.contents, done.contents, ["key"]), added(index.containers, done.containers, ["container_key"]), entries)
    return merged, owned.unionByName(gained), status


def empty_index(spark: SparkSession) -> tuple[Ingested, DataFrame]:
    """An index without rows, and what tenants own of it."""
    ref = "content_hash string, leaf_size bigint, container boolean"
    tables = (f"key string, {ref}, mime_type string", "key string, content binary", "container_key string, format_key string, entry_count bigint", ENTRIES)
    return Ingested(*(spark.createDataFrame([], x) for x in tables)), spark.createDataFrame([], f"tenant string, key string, {ref}")


def manifests_of(done: Ingested) -> DataFrame:
    """One manifest row per container, empty ones included: container_key, format_key, entry_count, entries in order."""
    entry = F.struct("ordinal", "path", "key", "entry_type", "mtime", "mode", "format_metadata")
    packed = done.entries.groupBy("container_key").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return done.containers.join(packed, "container_key", "left").select("container_key", "format_key", "entry_count", F.coalesce("entries", F.array().cast(packed.schema["entries"].dataType)).alias("entries"))


def rebuild(manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refs, containers, entries) of an index from manifests alone, in one plan: ids are the natural keys."""
    entries = manifests.select("container_key", F.explode("entries").alias("e")).select("container_key", "e.*")
    refs = manifests.select(F.col("container_key").alias("key")).unionByName(entries.select("key")).distinct()
    return refs, manifests.select("container_key", "format_key", "entry_count"), entries


def rebuild_counts(manifests: DataFrame) -> DataFrame:
    """refs, containers, entries: what a rebuild that truncates first puts in."""
    tables = dict(zip(("refs", "containers", "entries"), rebuild(manifests), strict=True))
    kinds = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("kind")) for name, df in tables.items()))
    return kinds.agg(*(F.count_if(F.col("kind") == name).alias(name) for name in tables))


def _written(parts: Iterator[dict]) -> dict:
    """The container of its parts in order; a row without a path stands for no part."""
    children, first = [], None
    for r in parts:
        first = first or r
        if r["path"] is not None:
            children.append(Child(r["path"], b"" if r["entry_type"] == 1 else bytes(r["content"]), r["mtime"], r["mode"], r["format_metadata"]))
    return {"container_key": first["container_key"], "content": WRITE[first["format_key"]](children)}


def reconstruct(manifests: DataFrame, contents: DataFrame, max_depth: int = 16) -> DataFrame:
    """container_key, content of every container, bottom-up: a round writes those whose parts are all there."""
    done = contents.select("key", "content")
    left = store(manifests, "left")
    for _ in range(max_depth + 1):
        if not left.limit(1).count():
            break
        parts = left.select("container_key", "format_key", F.explode_outer("entries").alias("e")).select("container_key", "format_key", "e.*")
        # Which parts are there is told by keys alone; contents join only those that are written.
        needed = parts.where(F.col("key").isNotNull() & (F.col("entry_type") != 1)).select("container_key", "key")
        waits = needed.join(done.select("key"), "key", "left_anti").select("container_key").distinct()
        ready = parts.join(waits, "container_key", "left_anti").join(done, "key", "left")
        columns = ("container_key", "format_key", "ordinal", "path", "entry_type", "mtime", "mode", "format_metadata", "content")
        built = store(in_groups(ready.select(*columns), "container_key", ["ordinal"], _written, "container_key string, content binary", "content"), "built")
        done = done.unionByName(built.select(F.col("container_key").alias("key"), "content"))
        left = store(left.join(built.select("container_key"), "container_key", "left_anti"), "left")
    else:
        raise ValueError("a container misses parts, or nesting is deeper than allowed")
    return done.join(manifests.select(F.col("container_key").alias("key")), "key", "left_semi").withColumnRenamed("key", "container_key")
