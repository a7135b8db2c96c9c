import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import codecs, formats, refs
from lodestrata.functions.hashing import blake3
from lodestrata.sources import manifest
from lodestrata.sources.archives import Child, own_extra, unpack_tar, unpack_zip, write_tar, write_zip


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_blake3_published_vectors():
    # The published test inputs are bytes 0, 1, ... 250, 0, 1, ...
    data = lambda n: bytes(i % 251 for i in range(n))
    assert blake3(b"", 32).hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(data(1), 32).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3(data(1024), 32).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3(data(1025), 32).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert len({blake3(data(n)) for n in (2047, 2048, 2049, 3072, 3073, 5000, 102400)}) == 7


@pytest.mark.parametrize("key,ok", [("a" * 32 + "-5", True), ("A" * 32 + "-5_", True), ("a" * 32, False), ("g" * 32 + "-5", False), ("a" * 31 + "-5", False), ("a" * 32 + "-x", False), ("a" * 32 + "-0", False), ("a" * 32 + "--5", False), ("a" * 32 + "-99999999999999999999", False), (None, False)])
def test_parse_key(spark, key, ok):
    got = one(spark, refs.parse_key(F.lit(key).cast("string")))
    assert (got is not None) == ok
    if ok:
        assert got["content_hash"] == "a" * 32 and got["leaf_size"] == 5 and got["container"] == key.endswith("_")


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb\rc\n", 3), ("\n\n", 2)])
def test_lines(spark, text, n):
    assert one(spark, refs.line_count(F.lit(text))) == n
    assert one(spark, refs.normal_lines(F.lit(text))) == "\n".join(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")[: n or 1])


@pytest.mark.parametrize("name,head,mime,handler", [("x.zip", b"", None, "zip"), ("x", b"PK\x03\x04", None, "zip"), ("x", b"PK", None, "fallback"), ("x", b"\0" * 257 + b"ustar", None, "tar"), ("a.b/X.TXT", b"", None, "text"), (".txt", b"", None, "fallback"), ("x", b"", "text/rare", "text"), ("x.docx", b"PK\x03\x04", None, "zip")])
def test_detect(spark, name, head, mime, handler):
    got = one(spark, formats.detect(F.lit(mime).cast("string"), F.lit(name), F.lit(bytearray(head))))
    assert got["handler"] == handler


def test_codecs(spark):
    for codec in ("gzip", "bzip2"):
        packed = codecs.ENCODE[codec](b"text" * 100)
        assert codecs.find_codec(packed) == codec and codecs.DECODE[codec](packed) == b"text" * 100
    with pytest.raises(ValueError):
        codecs.ENCODE["bzip2"](b"x", 0)
    assert one(spark, codecs.codec_of(F.lit(bytearray(b"\x1f\x8b")), F.lit("x"))) == "gzip"
    assert one(spark, codecs.codec_of(F.lit(bytearray(b"")), F.lit("x.bz2"))) == "bzip2"


def test_archives_and_manifest():
    made = [Child("a.txt", b"one", 1704067200000, 0o644), Child("d/b.bin", b"\0\1", 1704067200000, 0o600)]
    assert write_zip(made) == write_zip(made)
    for write, read in ((write_zip, unpack_zip), (write_tar, unpack_tar)):
        assert [(c.path, c.content, c.mtime, c.mode) for c in read(write(made))] == [(c.path, c.content, c.mtime, c.mode) for c in made]
    import gzip

    assert [c.path for c in unpack_tar(gzip.compress(write_tar(made)))] == ["a.txt", "d/b.bin"]
    m = {"container_hash": b"h" * 16, "container_size": 300, "format_key": "zip", "format_metadata": b"", "reconstruction_tier": 0, "entries": [{"path": "ä", "content_hash": b"c" * 16, "leaf_size": 7, "is_container": True, "entry_type": 1, "mtime": -5, "format_metadata": b"x"}]}
    assert manifest.decode(manifest.encode(m)) == m | {"reconstruction_tier": 1}
    with pytest.raises((ValueError, IndexError)):
        manifest.decode(manifest.encode(m)[:-3])


def test_blake3_lanes_of_a_batch():
    import random

    from lodestrata.functions.hashing import blake3, blake3_many

    assert blake3(b"", 32).hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc", 32).hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    rng = random.Random(3)
    contents = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 9000, 31744, 40000)]
    assert blake3_many(contents) == [blake3(x) for x in contents] and blake3_many([]) == []


def test_zip_entries_are_written_as_they_were():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for name, method in (("a.txt", zipfile.ZIP_DEFLATED), ("b/", zipfile.ZIP_STORED), ("c.bin", zipfile.ZIP_STORED)):
            info = zipfile.ZipInfo(name, (2024, 2, 29, 12, 30, 42))
            info.compress_type, info.create_system, info.internal_attr = method, 0, 1
            info.external_attr, info.comment = (0o100640 << 16) | 0x20, b"said of " + name.encode()
            info.extra = b"UT\x05\x00\x01\x00\x01\x02\x03"
            z.writestr(info, b"" if name == "b/" else b"content " * 50)
    assert write_zip(list(unpack_zip(made.getvalue()))) == made.getvalue()
    assert own_extra(b"\x01\x00\x02\x00xxUT\x01\x00y") == b"UT\x01\x00y"
