"""Merges into the catalogue: deduplication and the upsert rules of each table.

Tables are logs of rows with a sequence column; a merge is an aggregation by natural key, so it
pre-aggregates before its one shuffle and needs no lock or update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REF = ["content_hash", "leaf_size", "container"]


def last_non_null(value: Column, seq: Column) -> Column:
    """Value of the greatest sequence among non-null values."""
    return F.max_by(value, F.when(value.isNotNull(), seq))


def upsert_refs(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per reference: earliest creation, last non-null MIME type, and how often it was seen."""
    return rows.groupBy(*REF).agg(F.min("created").alias("created"), last_non_null(F.col("mime_type"), F.col(seq)).alias("mime_type"), F.count(F.lit(1)).alias("seen"))


def tenant_blobs(rows: DataFrame, tenant: str = "tenant") -> DataFrame:
    return rows.select(tenant, *REF).distinct()


def first_wins(rows: DataFrame, keys: list[str], seq: str, offered: str | None = None) -> DataFrame:
    """The row of the least sequence for each key; ties to the least row. offered names a column for how many there were."""
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*keys).agg(F.min(F.struct(seq, *(c for c in rest if c != seq))).alias("r"), F.count(F.lit(1)).alias("_n"))
    return won.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest), *([F.col("_n").alias(offered)] if offered else [])).select(*rows.columns, *([offered] if offered else []))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key the table lacks, one per key."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def merge_json(rows: DataFrame, key: str, document: str, seq: str) -> DataFrame:
    """Shallow merge of JSON objects by key: the last writer of each top-level name wins; values keep their types, nulls and nesting."""
    pairs = rows.select(key, seq, F.explode(F.from_json(document, "map<string,variant>")).alias("name", "value"))
    last = pairs.groupBy(key, "name").agg(F.max_by(F.coalesce(F.to_json("value"), F.lit("null")), seq).alias("value"))
    name = F.concat(F.lit('"'), F.regexp_replace("name", r'(["\\\\])', r"\\\\$1"), F.lit('"'))
    members = F.sort_array(F.collect_list(F.concat(name, F.lit(":"), "value")))
    return last.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias(document))


def dedup_status(incoming: DataFrame, blobs: DataFrame, tenant: str = "tenant") -> DataFrame:
    """incoming with status: full_hit (this tenant has it), ref_hit (another has), new."""
    refs = blobs.select(*REF).distinct().withColumn("_ref", F.lit(True))
    own = blobs.select(tenant, *REF).distinct().withColumn("_own", F.lit(True))
    status = F.when(F.col("_own"), "full_hit").when(F.col("_ref"), "ref_hit").otherwise("new")
    return incoming.join(own, [tenant, *REF], "left").join(refs, REF, "left").withColumn("status", status).drop("_own", "_ref")


def arrival_status(rows: DataFrame, seq: str, tenant: str = "tenant") -> DataFrame:
    """rows with status against the rows before them by seq: full_hit (this tenant had it), ref_hit (another had), new."""
    first_ref = rows.groupBy(*REF).agg(F.min(seq).alias("_ref"))
    first_own = rows.groupBy(tenant, *REF).agg(F.min(seq).alias("_own"))
    status = F.when(F.col("_own") < F.col(seq), "full_hit").when(F.col("_ref") < F.col(seq), "ref_hit").otherwise("new")
    return rows.join(first_own, [tenant, *REF]).join(first_ref, REF).withColumn("status", status).drop("_own", "_ref")


def node_heartbeats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.lower("hostname").alias("hostname")).agg(F.max("last_seen").alias("last_seen"))


def task_deps(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Dependencies (task_id, depends_on) to insert: those that aren't there yet, once each, none of a task on itself."""
    return insert_if_absent(existing, new.where("task_id <> depends_on").select("task_id", "depends_on"), ["task_id", "depends_on"])


def resource_deps(wanted: DataFrame, resources: DataFrame, lenient: bool = False) -> DataFrame:
    """task_id, resource_id of named resources. An unknown name raises when the plan runs, unless lenient drops it."""
    found = wanted.join(resources.select(F.lower("name").alias("_n"), F.col("id").alias("resource_id")), F.lower("name") == F.col("_n"), "inner" if lenient else "left")
    if not lenient:
        found = found.withColumn("resource_id", F.when(F.col("resource_id").isNull(), F.raise_error(F.concat(F.lit("unknown resource "), F.col("name"))).cast("int")).otherwise(F.col("resource_id")))
    return found.select("task_id", "resource_id").distinct()


def manifests(children: DataFrame) -> DataFrame:
    """One row per container: its entries in archive order, and how many children it had, duplicates counted."""
    entry = F.struct("ordinal", "path", *REF, "entry_type", "mtime")
    return children.groupBy("container_key").agg(F.count(F.lit(1)).alias("entry_count"), F.sort_array(F.collect_list(entry)).alias("entries"))
