"""Further registered queries, each a library operator applied to whole tables, beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import leaves, refs
from ..operators import catalog, ingest, provenance, security, tasks
from ..scratch import scratch_dir
from ..sources import manifest
from ..sources.object_store import ObjectStore
from ..streaming import tasks as streams
from .registry import ARCHIVE_SQL, CHILD_SQL, NOW, REF_SQL, _archives, children_of, n, query, refs_of, resource_rows, task_rows


def scratch_path(df: DataFrame, name: str) -> str:
    return f"{scratch_dir(df.sparkSession)}/lodestrata/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- catalogue merges

@query(f"SELECT content_hash, leaf_size, min(doc_id) AS created, arg_max(lang, doc_id) FILTER (lang <> 'en') AS mime_type, count(*) AS seen FROM ({REF_SQL}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL", "documents")
def refs_upserted(docs):
    rows = refs_of(docs).join(docs.select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("mime_type")), "doc_id")
    return catalog.upsert_refs(rows.withColumn("created", F.col("doc_id")), "doc_id").drop("container")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "orders")
def containers_inserted(orders):
    return catalog.insert_if_absent(orders.where("o_orderstatus = 'F'"), orders.select("o_custkey"), ["o_custkey"])


@query("SELECT DISTINCT l_orderkey AS task_id, l_suppkey AS depends_on FROM lineitem WHERE l_orderkey <> l_suppkey EXCEPT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'", "lineitem")
def deps_inserted(lineitem):
    deps = lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("depends_on"), "l_returnflag")
    return catalog.task_deps(deps.where("l_returnflag = 'R'"), deps)


@query(f"WITH r AS ({REF_SQL}), f AS (SELECT content_hash, leaf_size, min(doc_id) AS first_ref FROM r GROUP BY ALL), o AS (SELECT tenant, content_hash, leaf_size, min(doc_id) AS first_own FROM r GROUP BY ALL) SELECT doc_id, CASE WHEN first_own < doc_id THEN 'full_hit' WHEN first_ref < doc_id THEN 'ref_hit' ELSE 'new' END AS status FROM r JOIN f USING (content_hash, leaf_size) JOIN o USING (tenant, content_hash, leaf_size)", "documents")
def arrival_status(docs):
    """Every document judged against those that arrived before it."""
    return catalog.arrival_status(refs_of(docs), "doc_id").select("doc_id", "status")


# --------------------------------------------------------------------------- tasks

@query("SELECT l_orderkey AS task_id, count(*) FILTER (p_size % 2 = 1) AS unfinished FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", "lineitem", "part")
def deps_unfinished(lineitem, part):
    deps = lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("depends_on"))
    return tasks.unfinished_deps(deps, part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, tasks.COMPLETE).otherwise(tasks.OPEN).alias("status")))


def chained(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders as tasks, open ones blocked by the order of the number before; and those dependencies."""
    status = F.when(F.col("status") == tasks.OPEN, tasks.BLOCKED).when(F.col("status") == tasks.IN_PROGRESS, tasks.IN_PROGRESS).otherwise(tasks.ERROR)
    rows = task_rows(orders).withColumn("status", status.cast("smallint")).withColumn("completed_at", F.lit(None).cast("timestamp"))
    return rows, orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") - 1).alias("depends_on"))


@query("WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 5 WHEN o_orderkey % 3 = 0 THEN 4 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS s FROM orders) SELECT a.id, CASE WHEN a.s = 2 AND coalesce(b.s = 4, false) THEN 0 ELSE a.s END AS status FROM a LEFT JOIN a b ON b.id = a.id - 1", "orders")
def tasks_completed(orders):
    rows, deps = chained(orders)
    done = tasks.complete(rows, deps, orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")), F.lit(NOW).cast("timestamp"))
    return done.select("id", F.col("status").cast("int").alias("status"))


@query(f"SELECT o_orderkey AS id, 0 AS status, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 128 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS INTEGER) AS priority, 0 AS retry_count, TIMESTAMP '{NOW}' AS created_at FROM orders", "orders")
def tasks_submitted(orders):
    new = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"))
    return tasks.submit(new, F.lit(NOW).cast("timestamp")).select("id", F.col("status").cast("int").alias("status"), F.col("priority").cast("int").alias("priority"), "retry_count", "created_at")


CAPACITY = 40
BATCH_SQL = f"SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE r <= {CAPACITY}"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey IN ({BATCH_SQL}) THEN 1 WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 5 ELSE 4 END AS status, CASE WHEN o_orderkey IN ({BATCH_SQL}) THEN 'node-1' END AS executor FROM orders", "orders")
def batch_claimed(orders):
    """A batch is claimed within each resource's capacity, and the claim applied to the task table."""
    res = resource_rows(orders.sparkSession).withColumn("max_concurrency", F.lit(CAPACITY))
    all_tasks = task_rows(orders).withColumn("status", F.when(F.col("status") == tasks.IN_PROGRESS, tasks.ERROR).otherwise(F.col("status")).cast("smallint"))
    deps = catalog.resource_deps(orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("name")), res)
    claimed = tasks.claim_batch(all_tasks, deps, res, ["1-URGENT", "2-high"], 1000)
    return tasks.apply_claim(all_tasks, claimed, "node-1", F.lit(NOW).cast("timestamp")).select("id", F.col("status").cast("int").alias("status"), "executor")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 4 WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS status, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 60 MINUTE ELSE CAST(o_orderdate AS TIMESTAMP) END AS expires_at FROM orders", "orders")
def tasks_in_background(orders):
    rows = task_rows(orders)
    out = tasks.to_background(rows, rows.where("id % 4 = 0").select("id"), F.lit(NOW).cast("timestamp"), 60)
    return out.select("id", F.col("status").cast("int").alias("status"), "expires_at")


ERRORS = ("java.io.IOException", "java.io.UncheckedIOException", "java.net.UnknownHostException", "java.util.concurrent.TimeoutException", "java.lang.IllegalStateException", "java.nio.file.NoSuchFileException", "java.lang.NullPointerException", "javax.net.ssl.SSLException")


@query("SELECT event_id, event_id % 8 IN (0, 2, 3, 5, 7) AS retryable FROM events", "events")
def errors_retryable(events):
    name = F.element_at(F.array(*(F.lit(x) for x in ERRORS)), (F.col("event_id") % len(ERRORS) + 1).cast("int"))
    return events.select("event_id", tasks.error_retryable(name).alias("retryable"))


# --------------------------------------------------------------------------- visibility

@query("SELECT doc_id, lang FROM documents WHERE source = 'src1'", "documents")
def tenant_rows(docs):
    return security.for_tenant(docs, "src1", "source").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND (lang = 'fr' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))", "documents", "labels")
def policy_rows(docs, labels):
    soft = security.soft_scope([{"kind": "fr"}], "source", "created", "lang")
    return security.row_policy(docs, "src1", "doc_id", labels.where("quality = 0"), soft, "source").select("doc_id")


# --------------------------------------------------------------------------- object store

def store_of(docs: DataFrame) -> ObjectStore:
    """A fresh store with every document as an object of its source."""
    store = ObjectStore(docs.sparkSession, scratch_path(docs, "objects"))
    r = refs_of(docs)
    key = refs.ref_key(F.col("content_hash"), F.col("leaf_size"), F.col("container"))
    store.create(r.join(docs.select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id").select("tenant", key.alias("key"), "content", F.lit("text/plain").alias("mime_type")))
    return store


OBJECT_SQL = f"SELECT DISTINCT tenant, content_hash || '-' || leaf_size AS key, content_hash FROM ({REF_SQL})"


@query(f"SELECT tenant, key, content_hash FROM ({OBJECT_SQL})", "documents")
def objects_read(docs):
    """Written once, every object reads back with the content of its reference."""
    store = store_of(docs)
    return store.read(store.table().select("tenant", "key")).select("tenant", "key", F.md5("content").alias("content_hash"))


@query(f"SELECT tenant, key, tenant <> 'src2' AS found FROM ({OBJECT_SQL})", "documents")
def objects_exist(docs):
    store = store_of(docs)
    wanted = store.table().select("tenant", "key")
    kept = ObjectStore(docs.sparkSession, scratch_path(docs, "objects"))
    kept.create(store.table())
    kept.delete_tenant("src2")
    return kept.exists(wanted)


@query("SELECT DISTINCT source AS tenant FROM documents", "documents")
def object_tenants(docs):
    return store_of(docs).tenants()


@query(f"SELECT count(*) AS objects FROM ({OBJECT_SQL}) WHERE NOT (tenant = 'src1' AND key = (SELECT min(key) FROM ({OBJECT_SQL}) WHERE tenant = 'src1'))", "documents")
def object_deleted(docs):
    store = store_of(docs)
    store.delete("src1", store.table().where("tenant = 'src1'").agg(F.min("key")).first()[0])
    return store.table().agg(n("objects"))


# --------------------------------------------------------------------------- manifests, rebuild, tiers

def manifests_with_keys(conv: DataFrame) -> DataFrame:
    key = refs.ref_key(F.col("content_hash"), F.col("leaf_size"), F.col("container"))
    entry = F.struct("ordinal", "path", key.alias("key"))
    made = children_of(conv).groupBy("container_key").agg(n("entry_count"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return made.select(F.col("container_key").cast("string").alias("container_key"), F.lit("zip").alias("format_key"), "entry_count", "entries")


@query(f"SELECT DISTINCT CAST(container_key AS VARCHAR) AS key FROM ({CHILD_SQL}) UNION SELECT content_hash || '-' || leaf_size FROM ({CHILD_SQL})", "conversations")
def refs_rebuilt(conv):
    return ingest.rebuild(manifests_with_keys(conv))[0]


@query(f"SELECT (SELECT count(*) FROM (SELECT CAST(container_key AS VARCHAR) FROM ({CHILD_SQL}) UNION SELECT content_hash || '-' || leaf_size FROM ({CHILD_SQL}))) AS refs, count(DISTINCT container_key) AS containers, count(*) AS entries FROM ({CHILD_SQL})", "conversations")
def rebuild_counters(conv):
    return ingest.rebuild_counts(manifests_with_keys(conv))


@query(f"SELECT container_key, count(*) OVER (PARTITION BY container_key) AS container_size, path, content_hash, leaf_size FROM ({CHILD_SQL})", "conversations")
def manifests_exchanged(conv):
    """Manifests written in the wire format and read back, entry by entry."""
    entry = F.struct("ordinal", "path", F.unhex("content_hash").alias("content_hash"), "leaf_size", F.col("container").alias("is_container"), "entry_type", F.lit(0).cast("bigint").alias("mtime"), F.lit(b"").alias("format_metadata"))
    made = children_of(conv).groupBy("container_key").agg(F.sort_array(F.collect_list(entry)).alias("entries"), n("container_size"))
    whole = made.withColumns({"container_hash": F.unhex(F.md5(F.col("container_key").cast("string"))), "format_key": F.lit("zip"), "format_metadata": F.lit(b""), "reconstruction_tier": F.lit(1)})
    back = manifest.encoded(whole).select("container_key", manifest.decoded(F.col("manifest")).alias("m"))
    e = back.select("container_key", "m.container_size", F.explode("m.entries").alias("e"))
    return e.select("container_key", "container_size", "e.path", F.lower(F.hex("e.content_hash")).alias("content_hash"), "e.leaf_size")


@query(f"SELECT 'original' AS kind, count(DISTINCT k) AS leaves FROM ({ARCHIVE_SQL}) UNION ALL SELECT 'part', count(DISTINCT md5(text)) FROM conversations", "conversations")
def ingest_tier2(conv):
    """Archives of tier 2 stay leaves of the index beside their parts."""
    from dataclasses import replace

    from ..functions.formats import CRITERIA

    done = ingest.ingest(_archives(conv), criteria=tuple(replace(c, tier=2) if c.handler == "zip" else c for c in CRITERIA))
    kind = F.when(F.col("mime_type") == "application/zip", "original").otherwise("part")
    return done.blobs.where("not container").groupBy(kind.alias("kind")).agg(n("leaves"))


FILE_SQL = "SELECT md5(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS leaf_size, role FROM conversations"


@query(f"WITH r AS (SELECT content_hash, leaf_size, bool_or(role = 'user') AS held FROM ({FILE_SQL}) GROUP BY ALL) SELECT tenant, content_hash, leaf_size, CASE WHEN tenant = 'a' THEN CASE WHEN held THEN 'full_hit' ELSE 'ref_hit' END WHEN held THEN 'ref_hit' ELSE 'new' END AS status, (SELECT count(*) FROM r) AS stored FROM r, (VALUES ('a'), ('b')) AS t(tenant)", "conversations")
def ingest_existing(conv):
    """All turns ingested as files by tenant b, then by a, which had those of users: the status of each, and how many contents are stored."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    files = conv.select("role", F.format_string("%s-%s.txt", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("filename"), text.alias("content"))
    index, owned = ingest.empty_index(conv.sparkSession)
    index, owned, _ = ingest.ingest_into(index, owned, files.where("role = 'user'"), "a")
    index, owned, of_b = ingest.ingest_into(index, owned, files, "b")
    index, owned, of_a = ingest.ingest_into(index, owned, files, "a")
    rows = of_b.unionByName(of_a).select("tenant", "content_hash", "leaf_size", "status")
    return rows.withColumn("stored", F.lit(index.contents.count()))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN doc_id % 2 = 0 THEN 'UTF-8' END AS charset, CASE WHEN doc_id % 2 = 0 THEN CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) END AS lines, CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS text_hash FROM documents", "documents")
def leaf_details(docs):
    """Metadata and text of documents, even ids as text, odd ones as images."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("image/png").alias("mime"))
    m = leaves.leaf_metadata(F.col("content"), F.col("mime"))
    return rows.select("doc_id", m.alias("m"), F.md5(leaves.leaf_text(F.col("content"), F.col("mime"))).alias("text_hash")).select("doc_id", "m.size", "m.charset", "m.lines", "text_hash")


# --------------------------------------------------------------------------- streams

@query(f"SELECT CASE o_orderstatus WHEN 'O' THEN 'task_available' ELSE 'task_completed' END AS channel, CAST(o_orderkey AS VARCHAR) AS task_id FROM orders WHERE o_orderstatus IN ('O', 'P')", "orders")
def task_notifications(orders):
    """The task log read as a stream; each change is told once."""
    log, sink = scratch_path(orders, "log"), scratch_path(orders, "told")
    rows = task_rows(orders)
    rows.write.parquet(log)
    streams.run_available(streams.notifications(streams.change_log(orders.sparkSession, log, rows.schema)), sink, scratch_path(orders, "offsets"))
    return orders.sparkSession.read.parquet(sink)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", "events")
def events_by_window(events):
    """Events counted in windows over a stream; a last file far ahead in time closes every window."""
    log, sink = scratch_path(events, "log"), scratch_path(events, "counts")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(log)
    end = rows.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select("ts", F.lit("end").alias("event_type"))
    checkpoint, spark = scratch_path(events, "offsets"), events.sparkSession
    streams.run_available(streams.event_counts(streams.change_log(spark, log, rows.schema)), sink, checkpoint)
    end.write.mode("append").parquet(log)
    streams.run_available(streams.event_counts(streams.change_log(spark, log, rows.schema)), sink, checkpoint)
    return spark.read.parquet(sink).where("event_type <> 'end'")


@query("SELECT l_orderkey AS parent, count(*) AS parts FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linestatus <> 'F') = 0", "lineitem")
def fan_in_ready(lineitem):
    """Fan-in countdown over a stream of finished parts: parents none of whose parts is missing."""
    log, sink = scratch_path(lineitem, "log"), scratch_path(lineitem, "ready")
    parts = lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linestatus").alias("status"))
    parts.write.parquet(log)
    needed = parts.groupBy("parent").agg(n("parts"))
    done = streams.change_log(lineitem.sparkSession, log, parts.schema).where("status = 'F'")
    return streams.fan_in(done, needed, "parent", "parts", sink, scratch_path(lineitem, "offsets"))


@query("SELECT p_partkey AS node, count(DISTINCT l_orderkey) AS containers FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1", "part", "lineitem")
def containers_counted(part, lineitem):
    pairs = provenance.containers_of(lineitem, part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "l_orderkey")
    return pairs.groupBy(F.col("l_partkey").alias("node")).agg(n("containers"))
