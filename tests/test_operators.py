import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import catalog, ingest, security, tasks, triggers
from lodestrata.sources.archives import Child, write_tar, write_zip
from lodestrata.sources.object_store import BlobNotFound, ObjectStore

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_ingest_nested_archives_and_rebuild(spark):
    inner = write_zip([Child("deep.txt", b"deep", 1704067200000), Child("same.txt", b"same", 1704067200000)])
    tar = write_tar([Child("t.txt", b"tar text", 1704067200000)])
    outer = write_zip([Child("readme.txt", b"same", 1704067200000), Child("docs/", b"", 1704067200000), Child("in.zip", inner, 1704067200000), Child("t.tar", tar, 1704067200000), Child("zero.txt", b"", 1704067200000)])
    roots = spark.createDataFrame([("outer.zip", bytearray(outer)), ("again.zip", bytearray(outer)), ("leaf.txt", bytearray(b"leaf")), ("empty.zip", bytearray(write_zip([])))], "filename string, content binary")
    done = ingest.ingest(roots)
    assert sorted(r.path for r in done.entries.collect()) == ["deep.txt", "docs/", "in.zip", "readme.txt", "same.txt", "t.tar", "t.txt", "zero.txt"]
    assert done.containers.where("entry_count = 5").count() == 1
    manifests = ingest.manifests_of(done)
    made = {r.container_key: bytes(r.content) for r in ingest.reconstruct(manifests, done.contents).collect()}
    assert outer in made.values() and inner in made.values() and tar in made.values()
    refs, containers, entries = ingest.rebuild(manifests)
    assert entries.select("container_key", "path", "key").exceptAll(done.entries.select("container_key", "path", "key")).count() == 0
    assert entries.count() == done.entries.count() and containers.count() == done.containers.count()


def test_ingest_into_an_existing_index(spark):
    """A second tenant's equal archive adds rows of ownership, no content, container or entry."""
    file = lambda *names: bytearray(write_zip([Child(x, x[0].encode(), 1704067200000) for x in names]))
    roots = lambda *rows: spark.createDataFrame(rows, "filename string, content binary")
    index, owned = ingest.empty_index(spark)
    index, owned, first = ingest.ingest_into(index, owned, roots(("x.zip", file("a.txt", "b.txt"))), "one")
    index, owned, second = ingest.ingest_into(index, owned, roots(("y.zip", file("a.txt", "b.txt")), ("z.zip", file("b.txt", "c.txt"))), "two")
    index, owned, third = ingest.ingest_into(index, owned, roots(("z.zip", file("b.txt", "c.txt"))), "two")
    found = lambda df: sorted(r.status for r in df.collect())
    assert found(first) == ["new"] * 3 and found(second) == ["new"] * 2 + ["ref_hit"] * 3 and found(third) == ["full_hit"] * 3
    assert (index.blobs.count(), index.contents.count(), index.containers.count(), index.entries.count()) == (5, 3, 2, 4)
    assert {r.tenant: r["count"] for r in owned.groupBy("tenant").count().collect()} == {"one": 3, "two": 5}
    assert ingest.reconstruct(ingest.manifests_of(index), index.contents).count() == 2


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/store")
    a, b = "a" * 32 + "-3", "b" * 32 + "-3_"
    row = lambda t, k, c: (k, bytearray(c), "text/plain", t)
    schema = "key string, content binary, mime_type string, tenant string"
    store.create(spark.createDataFrame([row("t1", a, b"one"), row("t1", b, b"two"), row("t2", a, b"own")], schema))
    store.create(spark.createDataFrame([row("t1", a, b"new")], schema))
    assert store.read_one("t1", a) == b"one" and store.read_one("t2", a) == b"own"
    assert [r.key for r in store.containers("t1").collect()] == [b]
    assert sorted(r[0] for r in store.tenants().collect()) == ["t1", "t2"]
    store.delete("t1", a)
    with pytest.raises(BlobNotFound):
        store.read_one("t1", a)
    with pytest.raises(BlobNotFound):
        store.delete("t1", a)
    asked = spark.createDataFrame([("t1", b), ("t1", a)], "tenant string, key string")
    assert sorted((r.key, r.found) for r in store.exists(asked).collect()) == [(a, False), (b, True)]
    store.delete_tenant("t2")
    store.delete_tenant("t2")
    assert [r[0] for r in store.tenants().collect()] == ["t1"]


def task_frame(spark, rows):
    return spark.createDataFrame([r + (dt.datetime(2023, 12, 31, 23, 50),) * 3 for r in rows], "id int, status smallint, priority smallint, executor string, retry_count int, created_at timestamp, claimed_at timestamp, expires_at timestamp").withColumn("completed_at", F.lit(None).cast("timestamp"))


def test_claims(spark):
    t = task_frame(spark, [(1, 0, 100, None, 0), (2, 0, 200, None, 0), (3, 1, 50, "n", 0), (4, 0, 250, None, 0), (5, 0, 90, None, 0), (6, 0, 90, None, 0)])
    res = spark.createDataFrame([(99, "Test-Service", None), (100, "limited", 2)], "id int, name string, max_concurrency int")
    deps = spark.createDataFrame([(4, 99), (3, 100), (5, 100), (6, 100)], "task_id int, resource_id int")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(tasks.claim_next(t, deps, res, ["LIMITED"])) == [2]
    assert ids(tasks.claim_next(t, deps, res, ["limited", "test-service"])) == [4]
    assert ids(tasks.claim_next(t, deps, res, [], 9)) == [2, 1]
    assert ids(tasks.claim_batch(t, deps, res, ["limited"], 9)) == [2, 1, 5]
    after = tasks.apply_claim(t, tasks.claim_next(t, deps, res, []), "node", now())
    assert [(r.id, r.executor) for r in after.where("status = 1").orderBy("id").collect()] == [(2, "node"), (3, "n")]


def test_transitions(spark):
    t = task_frame(spark, [(1, 2, 1, "old", 0), (2, 1, 1, "n", 0), (3, 4, 1, "n", 0), (4, 3, 1, "n", 0), (5, 7, 1, None, 0)])
    deps = spark.createDataFrame([(1, 2), (1, 3)], "task_id int, depends_on int")
    done = tasks.complete(t, deps, spark.createDataFrame([(2,), (5,)], "id int"), now())
    state = {r.id: (r.status, r.executor) for r in done.collect()}
    assert state[1] == (0, None) and state[2][0] == 4 and state[5][0] == 7
    swept = {r.id: (r.status, r.retry_count) for r in tasks.stale_sweep(t, now()).collect()}
    assert swept[2] == (0, 1) and swept[4] == (7, 0) and swept[3] == (4, 0)
    late = tasks.to_background(t, spark.createDataFrame([(2,), (3,)], "id int"), now(), 60)
    assert {r.id: r.status for r in late.collect()}[2] == 3
    reg = tasks.Registry()
    reg.register("x", int)
    with pytest.raises(ValueError):
        reg.register("X", str)


def test_merges(spark):
    docs = spark.createDataFrame([(1, '{"a":"1","b":"2"}', 1), (1, '{"b":"3"}', 2), (2, '{"c":"4"}', 1)], "id int, doc string, seq int")
    assert {r.id: r.doc for r in catalog.merge_json(docs, "id", "doc", "seq").collect()} == {1: '{"a":"1","b":"3"}', 2: '{"c":"4"}'}
    wanted = spark.createDataFrame([(1, "X"), (2, "none")], "task_id int, name string")
    res = spark.createDataFrame([(7, "x")], "id int, name string")
    assert [tuple(r) for r in catalog.resource_deps(wanted, res, lenient=True).collect()] == [(1, 7)]
    with pytest.raises(Exception, match="unknown resource"):
        catalog.resource_deps(wanted, res).collect()


def test_triggers_and_security(spark):
    for bad in ("", "a =", "a = 1 b", "(a = 1", "1 = a", "a ~ 1"):
        with pytest.raises(ValueError):
            triggers.compile_match(bad)
    df = spark.createDataFrame([("ab", 1), ("b'c", 5)], "s string, n int")
    assert df.where(triggers.compile_match("s contains '''' AND (n > 4 OR n = 9)")).count() == 1
    rows = spark.createDataFrame([("admin", None, True), ("write", ["read"], False), ("read", None, False), (None, None, False)], "role string, caps array<string>, ok boolean")
    assert rows.where(security.may(F.col("role"), F.col("caps"), "write") != F.col("ok")).count() == 0


def test_walk_has_no_row_or_depth_cap(spark):
    from oracle import compare

    from lodestrata.operators import provenance
    from lodestrata.plans import registry
    from lodestrata.scratch import store

    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "20")
    try:
        compare(spark, registry.QUERIES["descendants_by_depth"], registry.SQL["descendants_by_depth"], "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(limit)
    edges = spark.createDataFrame([(i, i + 1) for i in range(34)] + [(100, 101), (101, 100)], "parent int, child int").coalesce(1)
    roots = spark.createDataFrame([(0,), (100,), (20,)], "node int").coalesce(1)
    want = {(0, i, i) for i in range(35)} | {(20, i, i - 20) for i in range(20, 35)} | {(100, 100, 0), (100, 101, 1)}
    assert sorted(map(tuple, provenance.walk(edges, roots, store).collect())) == sorted(want)


def test_streaming(spark, tmp_path):
    from lodestrata.streaming import tasks as st

    log = spark.createDataFrame([(1, 0), (2, 4), (3, 1)], "id int, status smallint")
    log.write.parquet(f"{tmp_path}/log")
    stream = st.notifications(st.change_log(spark, f"{tmp_path}/log", log.schema))
    st.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    st.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("task_available", "1"), ("task_completed", "2")]
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    claims = spark.createDataFrame([(1, t(0), "claim"), (2, t(0), "claim"), (2, t(2), "release"), (9, t(40), "release")], "task_id int, ts timestamp, kind string")
    claims.write.parquet(f"{tmp_path}/claims")
    st.run_available(st.overdue(spark.readStream.schema(claims.schema).parquet(f"{tmp_path}/claims")), f"{tmp_path}/late", f"{tmp_path}/ck2")
    assert [r.task_id for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [1]


def test_merge_json_keeps_types(spark):
    from lodestrata.operators.catalog import merge_json

    rows = spark.createDataFrame([(1, 1, '{"a": 1, "b": {"c": [1, null]}}'), (1, 2, '{"a": true, "d": null, "e": "x"}')], "k int, seq int, doc string")
    assert merge_json(rows, "k", "doc", "seq").first().doc == '{"a":true,"b":{"c":[1,null]},"d":null,"e":"x"}'


def test_a_scratch_folder_must_be_shared():
    from types import SimpleNamespace as S

    import pytest

    from lodestrata.scratch import scratch_dir

    conf = S(get=lambda *a: None)
    unset = S(isDefined=lambda: False)
    context = S(getConf=lambda: conf, _jsc=S(sc=lambda: S(getCheckpointDir=lambda: unset)), master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(S(sparkContext=context, conf=conf))
