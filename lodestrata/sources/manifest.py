"""Manifests in the protobuf wire format, for exchange; inside the engine they are nested Parquet rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import bound_batches, in_arrow, parts, release

#: Field numbers. Wire types: 0 varint, 2 bytes.
MANIFEST = {1: "container_hash", 2: "container_size", 3: "format_key", 4: "format_metadata", 5: "entries", 6: "reconstruction_tier"}
ENTRY = {1: "path", 2: "content_hash", 3: "leaf_size", 4: "is_container", 5: "entry_type", 6: "mtime", 7: "format_metadata"}
_TEXT = {"format_key", "path"}
_FLAG = {"is_container"}
_NUMBER = {"container_size", "reconstruction_tier", "leaf_size", "entry_type", "mtime"}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _write(fields: dict[int, str], row: dict) -> bytes:
    out = bytearray()
    for number, name in fields.items():
        value = row.get(name)
        if name == "entries":
            for e in value or ():
                body = _write(ENTRY, e)
                out += _varint(number << 3 | 2) + _varint(len(body)) + body
        elif value:  # default values aren't written
            if name in _NUMBER or name in _FLAG:
                out += _varint(number << 3) + _varint(int(value))
            else:
                body = value.encode() if name in _TEXT else bytes(value)
                out += _varint(number << 3 | 2) + _varint(len(body)) + body
    return bytes(out)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            n = number()
            if at + n > len(data):
                raise ValueError("truncated message")
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")


def _read(fields: dict[int, str], data: bytes) -> dict:
    row = {name: [] if name == "entries" else False if name in _FLAG else 0 if name in _NUMBER else "" if name in _TEXT else b"" for name in fields.values()}
    for number, value in _fields(data):
        name = fields.get(number)
        if name == "entries":
            row[name].append(_read(ENTRY, value))
        elif name in _FLAG:
            row[name] = bool(value)
        elif name in _NUMBER:
            row[name] = value - (1 << 64) if value >> 63 else value
        elif name in _TEXT:
            row[name] = value.decode()
        elif name:
            row[name] = value
    return row


def encode(manifest: dict) -> bytes:
    return _write(MANIFEST, manifest)


def decode(data: bytes) -> dict:
    """The manifest as nested dicts; an unset tier counts as 1."""
    out = _read(MANIFEST, data)
    out["reconstruction_tier"] = out["reconstruction_tier"] or 1
    return out


ENTRY_TYPE = "struct<path:string,content_hash:binary,leaf_size:bigint,is_container:boolean,entry_type:int,mtime:bigint,format_metadata:binary>"
MANIFEST_TYPE = f"struct<container_hash:binary,container_size:bigint,format_key:string,format_metadata:binary,entries:array<{ENTRY_TYPE}>,reconstruction_tier:int>"
_ARROW = {name: pa.string() if name in _TEXT else pa.bool_() if name in _FLAG else pa.int64() if name in _NUMBER else pa.binary() for name in (*MANIFEST.values(), *ENTRY.values())}
_ARROW |= {"entry_type": pa.int32(), "reconstruction_tier": pa.int32()}
_ARROW["entries"] = pa.list_(pa.struct([(name, _ARROW[name]) for name in ENTRY.values()]))


def encoded(manifests: DataFrame) -> DataFrame:
    """Sink side: container_key and the wire form of manifests(container_key, and the fields of MANIFEST), a slice of manifests at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                wire = pa.array([encode(row) for row in part.drop_columns(["container_key"]).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("container_key"), wire], ["container_key", "manifest"])

    return in_arrow(manifests.select("container_key", *MANIFEST.values()), run, f"container_key {manifests.schema['container_key'].dataType.simpleString()}, manifest binary")


def decoded(wire: Column) -> Column:
    """Source side: wire form to a struct of MANIFEST_TYPE, a slice of messages at a time; null stays null."""
    bound_batches()
    struct = pa.struct([(name, _ARROW[name]) for name in MANIFEST.values()])

    @F.arrow_udf(MANIFEST_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for values in batches:
                for part in parts(values):
                    yield pa.array([None if x is None else decode(x) for x in part.to_pylist()], struct)
        finally:
            release()

    # Otherwise each field that is read of the struct gets a decoding of its own.
    return run.asNondeterministic()(wire)
