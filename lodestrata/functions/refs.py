"""Content references: the triple (hash, size, is container) and its string key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key form: 32 hex digits, a dash, a positive decimal size, and a trailing underscore for containers.
KEY = r"^([0-9a-fA-F]{32})-\+?([0-9]+)(_?)$"


def ref_key(content_hash: Column, leaf_size: Column, container: Column) -> Column:
    """hex-size, with _ for a container. content_hash: binary or a hex string."""
    return F.concat(F.lower(content_hash), F.lit("-"), leaf_size.cast("string"), F.when(container, "_").otherwise(""))


def hash_hex(content_hash: Column) -> Column:
    return F.lower(F.hex(content_hash))


def parse_key(key: Column) -> Column:
    """struct(content_hash, leaf_size, container), null for what isn't a key: no dash, bad hash, bad or zero size."""
    size = F.regexp_extract(key, KEY, 2).try_cast("bigint")
    ok = key.rlike(KEY) & (size > 0)
    return F.when(ok, F.struct(F.lower(F.regexp_extract(key, KEY, 1)).alias("content_hash"), size.alias("leaf_size"), (F.regexp_extract(key, KEY, 3) == "_").alias("container")))


def shard_path(tenant: Column, content_hash: Column, key: Column) -> Column:
    """tenant/first two hex digits/next two/key."""
    return F.concat_ws("/", tenant, F.substring(content_hash, 1, 2), F.substring(content_hash, 3, 2), key)


def tenant_key(global_id: Column, tenant_id: Column) -> Column:
    return F.coalesce(F.lower(global_id), tenant_id.cast("string"))


def entry_type(path: Column) -> Column:
    """1 for a path that ends in a slash, else 0."""
    return F.when(path.endswith("/"), 1).otherwise(0)


def format_key(path: Column) -> Column:
    p = F.lower(path)
    tar = p.endswith(".tar") | p.endswith(".tar.gz") | p.endswith(".tgz") | p.endswith(".tar.bz2")
    return F.when(p.endswith(".zip"), "zip").when(tar, "tar").otherwise("unknown")


def line_count(text: Column) -> Column:
    """Lines ended by \\n, \\r or \\r\\n; an empty text has none and a last line end starts none."""
    plain = F.regexp_replace(text, "\r\n|\r", "\n")
    trimmed = F.when(plain.endswith("\n"), F.expr("1")).otherwise(0)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(plain, "\n", -1)) - trimmed).cast("bigint")


def normal_lines(text: Column) -> Column:
    """Lines joined by \\n, without a last line end."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "\n\\z", "")


def posix_mode(attributes: Column) -> Column:
    """Upper 16 bits of external attributes; 0 gives null."""
    mode = F.shiftrightunsigned(attributes.cast("bigint"), 16).bitwiseAND(F.lit(0xFFFF))
    return F.nullif(mode, F.lit(0).cast("bigint"))


def header(content: Column, n: int = 512) -> Column:
    """First n bytes, 64 KB at most."""
    return F.substring(content, 1, min(n, 65536))
