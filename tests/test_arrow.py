import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.arrow import ARROW_BYTES, BATCH_BYTES, byte_size, parts
from lodestrata.sources import manifest


@pytest.fixture
def unbounded(spark):
    """A session whose Arrow batches hold more bytes than a step may take at once."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, "1g")
    yield spark
    spark.conf.set(ARROW_BYTES, before)


def bound(spark):
    return byte_size(spark.conf.get(ARROW_BYTES))


def test_parts_hold_bounded_bytes():
    rows = pa.RecordBatch.from_pydict({"x": [[{"a": "b" * 1000}] * 10] * 500})
    cut = list(parts(rows, 100_000))
    assert max(p.nbytes for p in cut) < 120_000 and sum(map(len, cut)) == 500
    assert [len(p) for p in parts(pa.array([b"x" * 5000, b"y"]), 10)] == [1, 1] and not list(parts(pa.array([], pa.binary())))


def test_manifests_pass_in_bounded_batches(unbounded):
    """A batch held 10,000 manifests of any length before."""
    spark = unbounded
    entry = F.struct(F.concat(F.lit("p"), F.col("i").cast("string")).alias("path"), F.unhex(F.md5(F.col("i").cast("string"))).alias("content_hash"), F.col("i").alias("leaf_size"), F.lit(False).alias("is_container"), F.lit(0).alias("entry_type"), F.lit(0).cast("bigint").alias("mtime"), F.lit(b"").alias("format_metadata"))
    made = spark.range(0, 60_000, 1, 1).withColumn("i", F.col("id")).groupBy((F.col("id") % 200).alias("container_key")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    whole = made.withColumns({"container_hash": F.lit(b"h"), "container_size": F.size("entries").cast("bigint"), "format_key": F.lit("zip"), "format_metadata": F.lit(b""), "reconstruction_tier": F.lit(1)})
    wire = manifest.encoded(whole)
    assert bound(spark) == BATCH_BYTES
    spark.conf.set(ARROW_BYTES, "1g")
    back = wire.select("container_key", manifest.decoded(F.col("manifest")).alias("m"))
    assert bound(spark) == BATCH_BYTES
    entries = lambda df, e: df.select("container_key", F.explode(e).alias("e")).select("container_key", "e.path", "e.content_hash", "e.leaf_size")
    assert entries(back, "m.entries").exceptAll(entries(whole, "entries")).count() == 0 and back.select(F.sum("m.container_size")).first()[0] == 60_000


def test_a_null_message_stays_null(spark):
    wire = spark.createDataFrame([(None,), (bytearray(manifest.encode({"container_size": 3})),)], "w binary")
    assert sorted((r.m and r.m.container_size for r in wire.select(manifest.decoded(F.col("w")).alias("m")).collect()), key=str) == [3, None]


def test_codecs_pass_in_bounded_batches(unbounded):
    """A batch held 10,000 contents of any length before."""
    from lodestrata.functions import codecs

    spark = unbounded
    raw = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.sha2(F.col("id").cast("string"), 512), 100)).cast("binary").alias("raw"))
    for codec in ("gzip", "bzip2"):
        spark.conf.set(ARROW_BYTES, "1g")
        back = raw.select("raw", codecs.decode(codecs.encode(F.col("raw"), codec, 1), codec).alias("back"))
        assert bound(spark) == BATCH_BYTES
        assert back.where(~F.col("raw").eqNullSafe(F.col("back"))).count() == 0 and back.where("back IS NULL").count() == 429


def test_groups_follow_each_other_through_batches(unbounded):
    """Groups longer and shorter than a batch, and a null one, come whole and in order."""
    from lodestrata.arrow import in_groups

    spark = unbounded
    rows = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 4 == 0, F.lit(-1)).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("id") % 997).cast("bigint").alias("k"), "id", F.repeat(F.lit("x"), 2000).alias("pad"))

    def run(group):
        ids = []
        for r in group:
            ids.append(r["id"])
        return {"k": r["k"], "n": len(ids), "ordered": str(ids == sorted(ids)), "pad": r["pad"].encode()}

    out = in_groups(rows, "k", ["id"], run, "k bigint, n bigint, ordered string, pad binary", "pad")
    assert bound(spark) == BATCH_BYTES
    assert {r.k: r.n for r in out.collect()} == {r.k: r["count"] for r in rows.groupBy("k").count().collect()} and out.where("ordered <> 'True'").count() == 0


def test_archives_are_written_and_unpacked_without_frames_per_archive(unbounded):
    """Three steps made a frame for each archive; now archives share bounded batches, and the bytes stay those of plain zipfile."""
    import io
    import zipfile

    from lodestrata.operators import ingest
    from lodestrata.plans import registry

    spark = unbounded
    texts = {(c, t): None if (c, t) == (3, 1) else "" if (c, t) == (3, 2) else f"{c} {t} " + "y" * (c % 50 * 100) for c in range(300) for t in range(c % 12 + 1)}
    conv = spark.createDataFrame([(c, t, "user" if t % 2 else "system", x) for (c, t), x in texts.items()], "conv_id bigint, turn bigint, role string, text string").repartition(7)
    archives = registry._archives(conv)
    plan = archives._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and bound(spark) == BATCH_BYTES
    for r in archives.collect():
        c = int(r.filename.removesuffix(".zip"))
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            assert [(i.filename, z.read(i).decode()) for i in z.infolist()] == [(f"{t}-{'user' if t % 2 else 'system'}.txt", texts[c, t] or "") for t in range(c % 12 + 1)]
    done = ingest.ingest(archives)
    assert done.entries.count() == len(texts)
    made = ingest.reconstruct(ingest.manifests_of(done), done.contents)
    assert sorted(bytes(r.content) for r in made.collect()) == sorted(bytes(r.content) for r in archives.collect())


def test_messages_are_decoded_once(spark):
    """Two fields read of the decoded struct took two decodings, each with its own worker."""
    from lodestrata.plans import library

    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = library.manifests_exchanged(conv)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    wire = spark.createDataFrame([(bytearray(manifest.encode({"entries": [{"path": "a"}, {"path": "b"}]})),)], "w binary")
    assert [r.e.path for r in wire.select(F.explode(manifest.decoded(F.col("w"))["entries"]).alias("e")).collect()] == ["a", "b"]
