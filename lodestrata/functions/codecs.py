"""Codecs by name: gzip and bzip2, found by magic bytes or extension."""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..arrow import bound_batches, trim

#: Magic bytes and extensions.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh"}
EXTENSIONS = {"gzip": (".gz", ".tgz"), "bzip2": (".bz2",)}


def _bzip2(data: bytes, level: int = 9) -> bytes:
    if not 1 <= level <= 9:
        raise ValueError("blockSize must be 1 to 9")
    return bz2.compress(data, level)


ENCODE: dict[str, Callable[..., bytes]] = {"gzip": lambda d, level=9: gzip.compress(d, level, mtime=0), "bzip2": _bzip2}
DECODE: dict[str, Callable[[bytes], bytes]] = {"gzip": gzip.decompress, "bzip2": bz2.decompress}


def find_codec(head: bytes, name: str = "") -> str | None:
    return next((k for k in MAGIC if head.startswith(MAGIC[k]) or name.lower().endswith(EXTENSIONS[k])), None)


def codec_of(content: Column, name: Column) -> Column:
    """Codec by magic or extension; null if none."""
    out = None
    for k in MAGIC:
        test = (F.hex(F.substring(content, 1, len(MAGIC[k]))) == MAGIC[k].hex().upper()) | F.lower(name).rlike("(" + "|".join(x.replace(".", "\\.") for x in EXTENSIONS[k]) + ")$")
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def _each(content: Column, f: Callable[[bytes], bytes]) -> Column:
    """f of each content, in batches of bounded bytes: of Python objects there is one content at a time besides the results."""
    bound_batches()

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        try:
            return pa.array((None if b is None else f(b) for b in (v.as_py() for v in x)), pa.binary(), size=len(x))
        finally:
            trim()

    return run(content)


def encode(content: Column, codec: str, level: int = 9) -> Column:
    if codec == "bzip2" and not 1 <= level <= 9:
        raise ValueError("blockSize must be 1 to 9")
    return _each(content, lambda b: ENCODE[codec](b, level))


def decode(content: Column, codec: str) -> Column:
    return _each(content, DECODE[codec])
