"""Registered queries and the SQL that DuckDB runs beside each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import in_groups
from ..functions import codecs, formats, refs
from ..functions.hashing import blake3_128
from ..operators import catalog, ingest, provenance, search, security, tasks, triggers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "1996-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, *tables: str):
    """Register a function of the named tables under its own name, with its SQL."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def refs_of(docs: DataFrame) -> DataFrame:
    """Documents as leaves of the tenant `source`: content leaves the plan with the hash."""
    return docs.select("doc_id", F.col("source").alias("tenant"), F.md5("text").alias("content_hash"), F.octet_length("text").cast("bigint").alias("leaf_size"), F.lit(False).alias("container"))


REF_SQL = "SELECT doc_id, source AS tenant, md5(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS leaf_size, false AS container FROM documents"
n = lambda name="n": F.count(F.lit(1)).alias(name)


# --------------------------------------------------------------------------- references and deduplication

@query(f"SELECT content_hash, leaf_size, min(doc_id) AS first_doc, count(*) AS ref_count FROM ({REF_SQL}) GROUP BY 1, 2", "documents")
def blob_ref_dedup(docs):
    return refs_of(docs).groupBy("content_hash", "leaf_size").agg(F.min("doc_id").alias("first_doc"), n("ref_count"))


@query(f"SELECT doc_id, content_hash || '-' || leaf_size AS ref_key, tenant || '/' || substr(content_hash, 1, 2) || '/' || substr(content_hash, 3, 2) || '/' || content_hash || '-' || leaf_size AS path FROM ({REF_SQL})", "documents")
def blob_ref_key(docs):
    key = refs.ref_key(F.col("content_hash"), F.col("leaf_size"), F.col("container"))
    return refs_of(docs).select("doc_id", key.alias("ref_key"), refs.shard_path(F.col("tenant"), F.col("content_hash"), key).alias("path"))


@query(
    """SELECT doc_id, CASE WHEN ok THEN lower(substr(k, 1, 32)) END AS content_hash, CASE WHEN ok THEN CAST(regexp_extract(k, '-([0-9]+)', 1) AS BIGINT) END AS leaf_size, CASE WHEN ok THEN k LIKE '%\\_' ESCAPE '\\' END AS container
    FROM (SELECT *, regexp_matches(k, '^[0-9a-fA-F]{32}-[0-9]+_?$') AND NOT regexp_matches(k, '-0+_?$') AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' || md5(text) ELSE upper(md5(text)) END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '-' END || CASE WHEN doc_id % 3 = 0 THEN '0' ELSE CAST(strlen(text) AS VARCHAR) END || CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '' END AS k FROM documents))""",
    "documents",
)
def parse_ref(docs):
    key = F.concat(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.md5("text"))).otherwise(F.upper(F.md5("text"))), F.when(F.col("doc_id") % 5 == 0, "").otherwise("-"), F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.octet_length("text").cast("string")), F.when(F.col("doc_id") % 2 == 0, "_").otherwise(""))
    return docs.select("doc_id", refs.parse_key(key).alias("r")).select("doc_id", "r.*")


@query(f"SELECT tenant, content_hash, leaf_size, count(*) AS copies FROM ({REF_SQL}) GROUP BY ALL HAVING count(*) > 1", "documents")
def tenant_dup_blobs(docs):
    return refs_of(docs).groupBy("tenant", "content_hash", "leaf_size").agg(n("copies")).where("copies > 1")


@query(f"SELECT tenant, sum(copies) AS total, count(*) AS distinct_refs, sum(copies * leaf_size) AS total_bytes, sum(leaf_size) AS distinct_bytes FROM (SELECT tenant, content_hash, leaf_size, count(*) AS copies FROM ({REF_SQL}) GROUP BY ALL) GROUP BY 1", "documents")
def tenant_dedup_stats(docs):
    per = refs_of(docs).groupBy("tenant", "content_hash", "leaf_size").agg(n("copies"))
    return per.groupBy("tenant").agg(F.sum("copies").alias("total"), n("distinct_refs"), F.sum(F.col("copies") * F.col("leaf_size")).alias("total_bytes"), F.sum("leaf_size").alias("distinct_bytes"))


@query(f"SELECT DISTINCT tenant, content_hash, leaf_size, container FROM ({REF_SQL})", "documents")
def tenant_blobs(docs):
    return catalog.tenant_blobs(refs_of(docs))


@query(f"WITH r AS ({REF_SQL}), b AS (FROM r SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)) SELECT doc_id, tenant, content_hash, CASE WHEN (tenant, content_hash, leaf_size) IN (SELECT (tenant, content_hash, leaf_size) FROM b) THEN 'full_hit' WHEN (content_hash, leaf_size) IN (SELECT (content_hash, leaf_size) FROM b) THEN 'ref_hit' ELSE 'new' END AS status FROM r", "documents")
def dedup_status(docs):
    """Every document against an index of the English ones."""
    return catalog.dedup_status(refs_of(docs), refs_of(docs.where("lang = 'en'"))).select("doc_id", "tenant", "content_hash", "status")


@query(f"SELECT DISTINCT content_hash, leaf_size FROM ({REF_SQL}) EXCEPT SELECT content_hash, leaf_size FROM ({REF_SQL}) WHERE tenant = 'src0'", "documents")
def refs_not_in_tenant(docs):
    r = refs_of(docs)
    return r.select("content_hash", "leaf_size").distinct().join(r.where("tenant = 'src0'").select("content_hash", "leaf_size"), ["content_hash", "leaf_size"], "left_anti")


@query(f"SELECT content_hash, leaf_size FROM ({REF_SQL}) WHERE tenant <> 'src0' INTERSECT SELECT content_hash, leaf_size FROM ({REF_SQL}) WHERE tenant = 'src0'", "documents")
def refs_shared_with_tenant(docs):
    r = refs_of(docs)
    return r.where("tenant <> 'src0'").select("content_hash", "leaf_size").distinct().join(r.where("tenant = 'src0'").select("content_hash", "leaf_size"), ["content_hash", "leaf_size"], "left_semi")


@query(f"SELECT doc_id, tenant, leaf_size FROM ({REF_SQL}) WHERE content_hash = (SELECT md5(text) FROM documents WHERE doc_id = 11)", "documents")
def blob_lookup(docs):
    wanted = docs.where("doc_id = 11").select(F.md5("text").alias("content_hash"))
    return refs_of(docs).join(wanted, "content_hash", "left_semi").select("doc_id", "tenant", "leaf_size")


@query(f"SELECT content_hash, count(*) AS refs FROM ({REF_SQL}) GROUP BY 1", "documents")
def hash_refcount(docs):
    return refs_of(docs).groupBy("content_hash").agg(n("refs"))


@query("SELECT source, lower(lang) AS storage_key, count(*) AS n FROM documents GROUP BY ALL", "documents")
def tenant_storage_key(docs):
    return docs.groupBy("source", refs.tenant_key(F.col("lang"), F.col("source")).alias("storage_key")).agg(n())


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END END AS lines, md5(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END) AS lines_hash FROM documents", "documents")
def line_count(docs):
    return docs.select("doc_id", refs.line_count(F.col("text")).alias("lines"), F.md5(refs.normal_lines(F.col("text"))).alias("lines_hash"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS leaf_size, 32 AS digits, count(*) OVER (PARTITION BY text) AS copies FROM documents", "documents")
def blake3_ref(docs):
    """DuckDB has no BLAKE3: the SQL compares sizes and that references are equal exactly where texts are."""
    hashed = docs.select("doc_id", F.lower(F.hex(blake3_128(F.col("text").cast("binary")))).alias("content_hash"), F.octet_length("text").cast("bigint").alias("leaf_size"))
    copies = hashed.groupBy("content_hash", "leaf_size").agg(n("copies"))
    return hashed.join(copies, ["content_hash", "leaf_size"]).select("doc_id", "leaf_size", F.length("content_hash").alias("digits"), "copies")


# --------------------------------------------------------------------------- formats

@query("SELECT page_id, CASE WHEN ext IN ('txt', 'md', 'log', 'text') THEN 'text' WHEN ext = 'zip' THEN 'zip' WHEN ext = 'tar' THEN 'tar' WHEN ext IN ('html', 'htm') OR html LIKE '<!DOCTYPE%' THEN 'html' ELSE 'fallback' END AS handler, CASE WHEN ext IN ('txt', 'md', 'log', 'text') THEN 'text/plain' WHEN ext = 'zip' THEN 'application/zip' WHEN ext = 'tar' THEN 'application/x-tar' WHEN ext IN ('html', 'htm') OR html LIKE '<!DOCTYPE%' THEN 'text/html' END AS mime_type FROM (SELECT *, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '.\\.([^.]*)$', 1)) AS ext FROM pages)", "pages")
def detect_mime(pages):
    html = formats.Criteria("html", ("text/html",), ("html", "htm"), b"<!DOCTYPE", 0, 150)
    found = formats.detect(F.lit(None).cast("string"), F.regexp_replace("url", "[?#].*$", ""), refs.header(F.col("html").cast("binary")), (*formats.CRITERIA, html))
    return pages.select("page_id", found.alias("f")).select("page_id", "f.handler", "f.mime_type")


MIME_SQL = "list_value('text/html','text/x-log','application/json','image/png','image/svg+xml','application/zip','application/gzip','audio/wav','application/rtf','video/mp4','application/vnd.ms-outlook','font/woff')[1 + page_id % 12]"


@query(f"SELECT page_id, mime, mime IN ('application/zip','application/x-tar','application/x-7z-compressed','application/x-rar-compressed','application/vnd.ms-outlook') AS has_children, mime LIKE 'text/%' OR mime IN ('application/json','application/xml','application/javascript','image/svg+xml','audio/wav','message/rfc822') AS compressible, mime LIKE 'text/%' OR mime IN ('application/rtf','application/json','application/xml') AS text_based, CASE WHEN (mime LIKE 'text/%' OR mime IN ('application/json','image/svg+xml','audio/wav')) AND strlen(html) >= 1024 THEN 'zstd' ELSE 'none' END AS codec FROM (SELECT page_id, html, {MIME_SQL} AS mime FROM pages)", "pages")
def mime_behavior(pages):
    kinds = ("text/html", "text/x-log", "application/json", "image/png", "image/svg+xml", "application/zip", "application/gzip", "audio/wav", "application/rtf", "video/mp4", "application/vnd.ms-outlook", "font/woff")
    mime = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("page_id") % 12 + 1).cast("int"))
    m = F.col("mime")
    return pages.withColumn("mime", mime).select("page_id", "mime", formats.has_children(m).alias("has_children"), formats.compressible(m).alias("compressible"), formats.text_based(m).alias("text_based"), formats.write_codec(m, F.octet_length("html")).alias("codec"))


PATH_SQL = "url || list_value('.zip', '.tar.gz', '/', '.TGZ', '')[1 + page_id % 5]"


@query(f"SELECT page_id, CASE WHEN suffix(p, '/') THEN 1 ELSE 0 END AS entry_type, CASE WHEN lower(p) LIKE '%.zip' THEN 'zip' WHEN regexp_matches(lower(p), '\\.(tar|tar\\.gz|tgz|tar\\.bz2)$') THEN 'tar' ELSE 'unknown' END AS format_key FROM (SELECT page_id, {PATH_SQL} AS p FROM pages)", "pages")
def entry_kind(pages):
    path = F.concat("url", F.element_at(F.array(*(F.lit(x) for x in (".zip", ".tar.gz", "/", ".TGZ", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    return pages.select("page_id", refs.entry_type(path).alias("entry_type"), refs.format_key(path).alias("format_key"))


@query("SELECT o_orderkey, CASE WHEN ((o_orderkey * 65537) >> 16) & 65535 = 0 THEN NULL ELSE CAST(((o_orderkey * 65537) >> 16) & 65535 AS BIGINT) END AS posix_mode, epoch_ms(o_orderdate) AS millis FROM orders", "orders")
def posix_mode_millis(orders):
    stamp = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", refs.posix_mode(F.col("o_orderkey") * 65537).alias("posix_mode"), stamp.alias("millis"))


@query("SELECT doc_id, md5(text) AS gzip_hash, md5(text) AS bzip2_hash FROM documents", "documents")
def codec_roundtrip(docs):
    raw = F.col("text").cast("binary")
    gz, bz = codecs.decode(codecs.encode(raw, "gzip"), "gzip"), codecs.decode(codecs.encode(raw, "bzip2", 1), "bzip2")
    return docs.select("doc_id", F.md5(gz).alias("gzip_hash"), F.md5(bz).alias("bzip2_hash"))


# --------------------------------------------------------------------------- containers and entries

CHILD_SQL = "SELECT conv_id AS container_key, CAST(turn AS INTEGER) AS ordinal, role || '/' || turn AS path, md5(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS leaf_size FROM conversations"


def children_of(conv: DataFrame) -> DataFrame:
    return conv.select(
        F.col("conv_id").alias("container_key"), F.col("turn").cast("int").alias("ordinal"), F.concat_ws("/", "role", F.col("turn").cast("string")).alias("path"), F.md5("text").alias("content_hash"),
        F.octet_length("text").cast("bigint").alias("leaf_size"), F.lit(False).alias("container"), F.lit(0).alias("entry_type"), F.lit(None).cast("bigint").alias("mtime"),
    )


@query(f"SELECT container_key, count(*) AS entry_count, string_agg(path || '=' || content_hash, ',' ORDER BY ordinal) AS entries FROM ({CHILD_SQL}) GROUP BY 1", "conversations")
def manifest_fanin(conv):
    made = catalog.manifests(children_of(conv))
    return made.select("container_key", "entry_count", F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["path"], e["content_hash"])), ",").alias("entries"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, count(*) AS offered FROM lineitem GROUP BY ALL", "lineitem")
def entry_first_wins(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return catalog.first_wins(rows, ["l_orderkey", "l_linenumber"], "l_partkey", offered="offered")


@query("SELECT l_orderkey, count(*) AS entry_count, count(DISTINCT l_linenumber) AS entries FROM lineitem GROUP BY 1", "lineitem")
def container_entry_counts(lineitem):
    per = lineitem.groupBy("l_orderkey", "l_linenumber").agg(n())
    return per.groupBy("l_orderkey").agg(F.sum("n").alias("entry_count"), n("entries"))


@query("SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7", "lineitem")
def container_entries(lineitem):
    return lineitem.where("l_orderkey = 7").select("l_linenumber", "l_partkey", "l_quantity")


@query("SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)", "lineitem", "part")
def containers_of_leaf(lineitem, part):
    return provenance.containers_of(lineitem, part.where("p_size = 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "l_orderkey")


@query("SELECT l_partkey, count(*) AS n_containers, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS containers FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1", "lineitem")
def blob_detail(lineitem):
    return provenance.blob_detail(lineitem, "l_partkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, concat_ws('/', r_name, n_name, c_custkey, o_orderkey, l_linenumber) AS path FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "region", "nation", "customer", "orders", "lineitem")
def ancestry_path(region, nation, customer, orders, lineitem):
    entries = lineitem.select("l_orderkey", "l_linenumber").distinct().join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    up = entries.join(customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return up.select("l_orderkey", "l_linenumber", F.concat_ws("/", "r_name", "n_name", *(F.col(c).cast("string") for c in ("c_custkey", "o_orderkey", "l_linenumber"))).alias("path"))


def _containment(region, nation, customer):
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    return edges.unionByName(customer.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))), region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


EDGE_SQL = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


@query(f"WITH RECURSIVE e AS ({EDGE_SQL}), reach(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, e.child, depth + 1 FROM reach JOIN e ON e.parent = node) SELECT root, depth, count(DISTINCT node) AS nodes FROM reach GROUP BY ALL", "region", "nation", "customer")
def descendants_by_depth(region, nation, customer):
    from ..scratch import store

    edges, roots = _containment(region, nation, customer)
    return provenance.walk(edges, roots, store).groupBy("root", "depth").agg(n("nodes"))


FAIL_EDGES = "SELECT n_nationkey AS parent, (n_nationkey * 2 + 1) % 25 AS child FROM nation WHERE n_nationkey % 7 <> 0"


@query(f"WITH RECURSIVE e AS ({FAIL_EDGES}), f(node, depth) AS (SELECT 1, 0 UNION SELECT e.child, depth + 1 FROM f JOIN e ON e.parent = node WHERE depth < 25) SELECT node, min(depth) AS depth FROM f GROUP BY 1", "nation")
def failure_cascade(nation):
    from ..scratch import store

    edges = nation.where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").alias("parent"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("child"))
    return provenance.reachable(edges, nation.where("n_nationkey = 1").select(F.col("n_nationkey").alias("node")), store)


@query(f"SELECT container_key, ordinal, path, content_hash, leaf_size FROM ({CHILD_SQL})", "conversations")
def rebuild_equals_index(conv):
    """The index rebuilt from manifests, row for row what the source holds."""
    made = catalog.manifests(children_of(conv))
    return made.select("container_key", F.explode("entries").alias("e")).select("container_key", "e.ordinal", "e.path", "e.content_hash", "e.leaf_size")


@query("SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'orders', count(*) FROM orders", "documents", "pages", "orders")
def row_counts(docs, pages, orders):
    one = lambda df, name: df.agg(n("rows")).select(F.lit(name).alias("name"), "rows")
    return one(docs, "documents").unionByName(one(pages, "pages")).unionByName(one(orders, "orders"))


def _archives(conv: DataFrame) -> DataFrame:
    """A ZIP per conversation, its turns as text files: input for the archive queries."""
    from ..sources.archives import Child, write_zip

    def pack(turns) -> dict:
        turns = list(turns)
        children = [Child(f"{r['turn']}-{r['role']}.txt", (r["text"] or "").encode(), 1704067200000) for r in turns]
        return {"filename": f"{turns[0]['conv_id']}.zip", "content": write_zip(children)}

    rows = conv.select("conv_id", "turn", "role", "text")
    return in_groups(rows, "conv_id", [F.asc_nulls_last("turn"), "role", "text"], pack, "filename string, content binary", "content")


@query("SELECT md5(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS leaf_size, count(*) AS entries FROM (SELECT DISTINCT turn, role, text, k FROM (SELECT turn, role, text, md5(string_agg(turn || role || text, chr(1) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS k FROM conversations)) GROUP BY ALL", "conversations")
def archive_ingest(conv):
    done = ingest.ingest(_archives(conv))
    return done.entries.join(done.blobs, "key").groupBy("content_hash", "leaf_size").agg(n("entries"))


ARCHIVE_SQL = "SELECT turn, role, text, md5(string_agg(turn || role || text, chr(1) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS k FROM conversations"


@query(f"SELECT count(DISTINCT k) AS containers, count(DISTINCT k) AS identical FROM ({ARCHIVE_SQL})", "conversations")
def archive_reconstruct(conv):
    """How many archives were rebuilt, and how many of them have the bytes that were ingested."""
    done = ingest.ingest(_archives(conv))
    made = ingest.reconstruct(ingest.manifests_of(done), done.contents)
    return made.agg(n("containers"), F.count_if(F.md5("content") == refs.parse_key(F.col("container_key"))["content_hash"]).alias("identical"))


# --------------------------------------------------------------------------- upserts over the event log

@query("SELECT user_id, min(ts) AS created, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS mime_type, count(*) AS seen FROM events GROUP BY 1", "events")
def upsert_last_nonnull(events):
    value = F.when(F.col("event_type") != "view", F.col("event_type"))
    return events.groupBy("user_id").agg(F.min("ts").alias("created"), catalog.last_non_null(value, F.col("event_id")).alias("mime_type"), n("seen"))


@query("SELECT user_id, '{\"k\":' || arg_max(CAST(json_extract(props, '$.k') AS VARCHAR), event_id) || '}' AS props FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1", "events")
def json_merge_last(events):
    return catalog.merge_json(events, "user_id", "props", "event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events")
def json_project(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1", "events")
def node_heartbeat(events):
    rows = events.select(F.col("user_id").cast("string").alias("hostname"), F.col("ts").alias("last_seen"))
    return catalog.node_heartbeats(rows).select(F.col("hostname").cast("bigint").alias("user_id"), "last_seen")


# --------------------------------------------------------------------------- tasks

def task_rows(orders: DataFrame) -> DataFrame:
    """Orders as tasks: status by order status, priority by price, one resource by order priority."""
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(4)
    stamp = F.col("o_orderdate").cast("timestamp")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("priority"), stamp.alias("created_at"), status.cast("smallint").alias("status"), F.lit(None).cast("string").alias("executor"), "o_orderpriority", F.lit(0).alias("retry_count"), stamp.alias("claimed_at"), stamp.alias("expires_at"))


def resource_rows(spark: SparkSession) -> DataFrame:
    rows = [(1, "1-URGENT", None), (2, "2-HIGH", 1), (3, "3-MEDIUM", 1_000_000_000), (4, "4-NOT SPECIFIED", None), (5, "5-LOW", None)]
    return spark.createDataFrame(rows, "id int, name string, max_concurrency int")


def deps_rows(orders: DataFrame, resources: DataFrame) -> DataFrame:
    return catalog.resource_deps(orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("name")), resources, lenient=True)


CLAIM_SQL = "SELECT o_orderkey AS id, o_totalprice AS priority FROM orders o WHERE o_orderstatus = 'O' AND lower(o_orderpriority) IN ('1-urgent', '2-high', '3-medium') AND NOT (o_orderpriority = '2-HIGH' AND (SELECT count(*) FROM orders x WHERE x.o_orderstatus = 'F' AND x.o_orderpriority = '2-HIGH') >= 1)"


@query(f"{CLAIM_SQL} ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 50", "orders")
def claim_topk(orders):
    res = resource_rows(orders.sparkSession)
    return tasks.claim_next(task_rows(orders), deps_rows(orders, res), res, ["1-urgent", "2-HIGH", "3-MEDIUM"], 50).select("id", "priority")


@query(CLAIM_SQL, "orders")
def claim_capacity(orders):
    res = resource_rows(orders.sparkSession)
    return tasks.claimable(task_rows(orders), deps_rows(orders, res), res, ["1-urgent", "2-HIGH", "3-MEDIUM"]).select("id", "priority")


@query("SELECT l_orderkey AS task_id, count(*) FILTER (l_linestatus <> 'F') AS unfinished FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linestatus <> 'F') = 0", "lineitem")
def deps_all_done(lineitem):
    return lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count_if(F.col("l_linestatus") != "F").alias("unfinished")).where("unfinished = 0")


@query("SELECT l_orderkey AS task_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'onError' WHEN bool_or(l_linestatus = 'F') THEN 'onResume' ELSE 'onStart' END AS phase FROM lineitem GROUP BY 1", "lineitem")
def dispatch_phase(lineitem):
    flags = lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("f"), F.bool_or(F.col("l_linestatus") == "F").alias("c"))
    return flags.select("task_id", tasks.dispatch_phase(F.col("f"), F.col("c")).alias("phase"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 4 WHEN o_orderpriority < '3' THEN 0 ELSE 5 END AS status FROM orders", "orders")
def retry_transition(orders):
    t = task_rows(orders)
    return t.select("id", tasks.failed_status(F.col("status"), F.col("o_orderpriority") < "3", F.col("retry_count")).cast("int").alias("status"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE THEN 0 WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 4 END AS status, CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS retry_count FROM orders", "orders")
def stale_leases(orders):
    return tasks.stale_sweep(task_rows(orders), F.lit(NOW).cast("timestamp")).select("id", F.col("status").cast("int").alias("status"), "retry_count")


@query("SELECT user_id AS service, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_type, (ts, event_id)) = 'RUNNING' OR arg_max(event_type, (ts, event_id)) = 'view' AS available FROM events GROUP BY 1", "events")
def service_available(events):
    named = events.withColumn("service", F.col("user_id")).withColumn("s", F.when(F.col("event_type") == "view", "RUNNING").otherwise(F.col("event_type")))
    last = tasks.services_available(named, "service", "s", ["ts", "event_id"])
    return last.select("service", F.when(F.col("state") == "RUNNING", "view").otherwise(F.col("state")).alias("state"), "available")


@query("SELECT event_id FROM events WHERE (event_type = 'purchase' AND value > 50) OR (starts_with(event_type, 'sign') AND contains(props, '8')) OR suffix(event_type, 'ror')", "events")
def trigger_match(events):
    return events.where(triggers.compile_match("(event_type = 'purchase' AND value > 50) OR event_type startsWith 'sign' AND props contains '8' OR event_type endsWith 'ror'")).select("event_id")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n_types FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 3", "events")
def join_trigger(events):
    return tasks.join_trigger(events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", 3)


# --------------------------------------------------------------------------- search and visibility

TOKENS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'of')) AS BIGINT) AS rank FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'of') ORDER BY rank DESC, doc_id LIMIT 20", "documents")
def fulltext_topk(docs):
    return search.full_text(docs, ["the", "of"])


@query(f"SELECT doc_id, CAST(len(list_filter(w, lambda x: x = 'die')) AS BIGINT) AS rank FROM (SELECT doc_id, lang, {TOKENS_SQL} AS w FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE lang = 'de' AND list_contains(w, 'die') ORDER BY rank DESC, doc_id LIMIT 10", "documents", "labels")
def search_blobs(docs, labels):
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id")
    return search.full_text(good, ["die"], 10, where=F.col("lang") == "de")


VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR_SQL}), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10", "embeddings")
def semantic_topk(emb):
    return search.nearest(emb, VECTOR, 10)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01' OR (o_orderdate = TIMESTAMP '1996-03-01' AND o_orderkey > 500) ORDER BY o_orderdate, o_orderkey LIMIT 101", "orders")
def keyset_page(orders):
    return search.keyset_page(orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100, search.encode_cursor("1996-03-01 00:00:00", 500))


@query("SELECT doc_id FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS hit FROM labels WHERE quality = 0) USING (doc_id) WHERE hit = 1 OR (source LIKE 'src1%' AND lang = 'fr') OR source = 'src3'", "documents", "labels")
def sandbox_visible(docs, labels):
    soft = security.soft_scope([{"like": "src1*", "kind": "fr"}, {"like": "src3"}], "source", "created", "lang")
    return security.visible(docs, "doc_id", labels.where("quality = 0"), soft).select("doc_id")


@query(f"SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND (o_orderstatus = 'O' OR o_orderdate > TIMESTAMP '{NOW}')", "orders", "customer")
def session_resolve(orders, customer):
    """Orders as sessions (open ones never expire) of customers as principals (active with a positive balance)."""
    expires = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp"))
    s = orders.select("o_orderkey", F.col("o_custkey").alias("principal_id"), expires.alias("expires_at"))
    p = customer.select(F.col("c_custkey").alias("principal_id"), (F.col("c_acctbal") > 0).alias("active"))
    return security.sessions(s, p, F.lit(NOW).cast("timestamp")).select("o_orderkey", F.col("principal_id").alias("c_custkey"))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_nationkey % 2 = 0 OR c_nationkey % 3 = 0) AS may_write FROM customer", "customer")
def role_check(customer):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "write").otherwise("read")
    caps = F.when(F.col("c_nationkey") % 2 != 0, F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("write"))).otherwise(F.array(F.lit("read"))))
    return customer.select("c_custkey", security.may(role, caps, "write").alias("may_write"))
