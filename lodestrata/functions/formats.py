"""Format detection and MIME behaviour as expressions over fixed tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criteria:
    handler: str
    mimes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    magic: bytes | None = None
    offset: int = 0
    priority: int = 0
    container: bool = False
    tier: int = 0

    def primary_mime(self) -> str | None:
        return next((m for m in self.mimes if "*" not in m), None)


#: The registered handlers, magic bytes, offsets and priorities.
CRITERIA = (
    Criteria("zip", ("application/zip",), ("zip",), b"PK\x03\x04", 0, 200, True, 1),
    Criteria("tar", ("application/x-tar",), ("tar",), b"ustar", 257, 200, True, 1),
    Criteria("text", ("text/plain", "text/*"), ("txt", "md", "log", "text"), None, 0, 100),
    Criteria("fallback", ("*/*",), ("*",), None, 0, -1),
)

#: MIME type -> (has children, compressible); "x/*" covers what isn't listed, all else is (False, False).
CONTAINERS = ("application/zip", "application/x-tar", "application/x-7z-compressed", "application/x-rar-compressed", "application/vnd.ms-outlook")
COMPRESSIBLE = (
    "text/*", "text/plain", "text/html", "text/xml", "text/csv", "application/json", "application/xml", "application/javascript",
    "image/svg+xml", "audio/wav", "message/rfc822",
)
TEXT_PARTS = ("pdf", "word", "document", "spreadsheet", "presentation", "opendocument", "msword", "ms-excel", "ms-powerpoint")
TEXT_NAMES = ("rtf", "json", "xml")


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def extension(filename: Column) -> Column:
    """Lower-case text after the last dot of the whole path, if that dot isn't first; else null."""
    at = F.length(filename) - F.length(F.substring_index(filename, ".", -1))
    return F.when(filename.contains(".") & (at > 1), F.lower(F.substring_index(filename, ".", -1)))


def matches(c: Criteria, mime: Column, filename: Column, head: Column) -> Column:
    """Magic, or MIME exact or by type, or extension, or a catch-all."""
    tests = []
    if c.magic is not None:
        tests.append(F.hex(F.substring(head, c.offset + 1, len(c.magic))) == c.magic.hex().upper())
    if "*/*" in c.mimes or "*" in c.extensions:
        tests.append(F.lit(True))
    tests.append(mime.isin(*c.mimes) | F.concat(F.substring_index(mime, "/", 1), F.lit("/*")).isin(*c.mimes))
    tests.append(extension(filename).isin(*c.extensions))
    return _any([F.coalesce(t, F.lit(False)) for t in tests])


def detect(mime: Column, filename: Column, head: Column, criteria: tuple[Criteria, ...] = CRITERIA) -> Column:
    """struct(handler, mime_type, container, tier) of the matching criteria of highest priority; ties to the first."""
    out = None
    for c in sorted(criteria, key=lambda c: -c.priority):
        value = F.struct(F.lit(c.handler).alias("handler"), F.lit(c.primary_mime()).cast("string").alias("mime_type"), F.lit(c.container).alias("container"), F.lit(c.tier).alias("tier"))
        test = matches(c, mime, filename, head)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def has_children(mime: Column) -> Column:
    return F.coalesce(mime.isin(*CONTAINERS), F.lit(False))


def compressible(mime: Column) -> Column:
    exact = mime.isin(*(m for m in COMPRESSIBLE if "*" not in m))
    return F.coalesce(exact | mime.startswith("text/"), F.lit(False))


def text_based(mime: Column) -> Column:
    sub = F.substring_index(mime, "/", -1)
    application = mime.startswith("application/") & (_any([sub.contains(x) for x in TEXT_PARTS]) | sub.isin(*TEXT_NAMES))
    return F.coalesce(mime.startswith("text/") | application, F.lit(False))


def write_codec(mime: Column, size: Column, least: int = 1024) -> Column:
    """Compression on write: zstd for compressible types of some size, else none."""
    return F.when(compressible(mime) & (size >= least), "zstd").otherwise("none")
