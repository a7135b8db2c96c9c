"""Archive handlers: unpack and write, dispatched by name inside Arrow batches. New formats register a handler."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrow import as_batch, in_arrow

#: Bytes of children that are held before they move on.
HELD_BYTES = 8 << 20
CHILD = "container_key string, ordinal int, path string, content binary, mtime bigint, mode int, format_metadata binary"


@dataclass
class Child:
    path: str
    content: bytes
    mtime: int | None = None
    mode: int | None = None
    metadata: bytes | None = None


def own_extra(extra: bytes) -> bytes:
    """The extra fields of an entry but that of 64-bit sizes, which the writer sets itself."""
    out, at = b"", 0
    while at + 4 <= len(extra):
        end = at + 4 + int.from_bytes(extra[at + 2 : at + 4], "little")
        out += extra[at:end] if extra[at : at + 2] != b"\x01\x00" else b""
        at = end
    return out


def zip_metadata(i: zipfile.ZipInfo) -> bytes:
    """What a ZIP entry says beside its path, time and content, for the writer to say again."""
    said = {"method": i.compress_type, "external": i.external_attr, "internal": i.internal_attr, "system": i.create_system, "version": i.create_version, "extra": own_extra(i.extra).hex(), "comment": i.comment.hex()}
    return json.dumps(said, sort_keys=True).encode()


def unpack_zip(data: bytes) -> Iterator[Child]:
    """Every entry, directories with empty content."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            stamp = int(datetime(*i.date_time, tzinfo=UTC).timestamp() * 1000) if i.date_time[1] and i.date_time[2] else None
            yield Child(i.filename, b"" if i.is_dir() else z.read(i), stamp, (i.external_attr >> 16) & 0xFFFF or None, zip_metadata(i))


def unpack_tar(data: bytes) -> Iterator[Child]:
    """Files only: directories and links are skipped. Compressed archives are read through their codec."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for m in t:
            if m.isfile():
                yield Child(m.name, t.extractfile(m).read(), int(m.mtime * 1000), m.mode)


def write_zip(children: list[Child]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for c in children:
            at = datetime.fromtimestamp((c.mtime or 315532800000) / 1000, UTC)
            info = zipfile.ZipInfo(c.path, (max(1980, at.year), at.month, at.day, at.hour, at.minute, at.second))
            said = json.loads(c.metadata) if c.metadata else {}
            info.compress_type, info.create_system = said.get("method", zipfile.ZIP_STORED), said.get("system", 3)
            info.external_attr, info.internal_attr = said.get("external", (c.mode or 0) << 16), said.get("internal", 0)
            info.create_version = said.get("version", info.create_version)
            info.extra, info.comment = bytes.fromhex(said.get("extra", "")), bytes.fromhex(said.get("comment", ""))
            z.writestr(info, c.content)
    return out.getvalue()


def write_tar(children: list[Child]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for c in children:
            info = tarfile.TarInfo(c.path)
            info.size, info.mtime, info.mode = len(c.content), (c.mtime or 0) // 1000, c.mode or 0o644
            t.addfile(info, io.BytesIO(c.content))
    return out.getvalue()


UNPACK: dict[str, Callable[[bytes], Iterator[Child]]] = {"zip": unpack_zip, "tar": unpack_tar}
WRITE: dict[str, Callable[[list[Child]], bytes]] = {"zip": write_zip, "tar": write_tar}


def unpack(containers: DataFrame) -> DataFrame:
    """Children of containers(container_key, handler, content): one archive in memory at a time, and of what is unpacked HELD_BYTES and a child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for key, handler, content in zip(*batch.columns, strict=True):
                key, unpacked = key.as_py(), UNPACK[handler.as_py()](content.as_py())
                for n, c in enumerate(unpacked):
                    rows.append({"container_key": key, "ordinal": n, "path": c.path, "content": c.content, "mtime": c.mtime, "mode": c.mode, "format_metadata": c.metadata})
                    held += len(c.content) + len(c.metadata or b"") + 256
                    if held >= HELD_BYTES:
                        yield as_batch(rows, CHILD)
                        rows, held = [], 0
        if rows:
            yield as_batch(rows, CHILD)

    return in_arrow(containers.select("container_key", "handler", "content"), run, CHILD)
