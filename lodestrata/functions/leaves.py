"""Metadata and text of leaves, as expressions over their content and detected format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import text_based
from .refs import line_count


def leaf_text(content: Column, mime: Column) -> Column:
    """Text of a text-based leaf, decoded as UTF-8 (null if it isn't valid); null for other formats."""
    return F.when(text_based(mime), F.try_validate_utf8(content.cast("string")))


def leaf_metadata(content: Column, mime: Column) -> Column:
    """struct(size, mime_type, charset, lines): lines and charset of text-based leaves only."""
    text = leaf_text(content, mime)
    return F.struct(
        F.octet_length(content).cast("bigint").alias("size"),
        mime.alias("mime_type"),
        F.when(text.isNotNull(), "UTF-8").alias("charset"),
        line_count(text).cast("bigint").alias("lines"),
    )
