"""Search and listing: full text, vectors, filters and keyset pages."""

from __future__ import annotations

import base64
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def term_rank(text: Column, terms: list[str]) -> Column:
    """Occurrences of all terms; null unless every term occurs."""
    words = tokens(text)

    def occurrences(term: str) -> Column:
        return F.size(F.filter(words, lambda x: x == term.lower()))

    counts = [occurrences(t) for t in terms]
    every = reduce(lambda a, b: a & b, [c > 0 for c in counts])
    return F.when(every, reduce(lambda a, b: a + b, counts))


def full_text(docs: DataFrame, terms: list[str], k: int = 20, id_col: str = "doc_id", where: Column | None = None) -> DataFrame:
    """id and rank of the k best documents; ties by id."""
    base = docs.where(where) if where is not None else docs
    hits = base.select(id_col, term_rank(F.col("text"), terms).cast("bigint").alias("rank")).where(F.col("rank").isNotNull())
    return hits.orderBy(F.desc("rank"), id_col).limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, F.round(cosine(F.col(column), q), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def encode_cursor(created: str, row_id: int) -> str:
    return base64.urlsafe_b64encode(f"{created}|{row_id}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, int]:
    created, _, row_id = base64.urlsafe_b64decode(cursor).decode().rpartition("|")
    return created, int(row_id)


def keyset_page(df: DataFrame, created: str, row_id: str, limit: int, cursor: str | None = None) -> DataFrame:
    """The rows after the cursor in (created, id) order; one more than the limit tells that there are more."""
    if cursor:
        at, last = decode_cursor(cursor)
        stamp = F.lit(at).cast(df.schema[created].dataType)
        df = df.where((F.col(created) > stamp) | ((F.col(created) == stamp) & (F.col(row_id) > last)))
    return df.orderBy(created, row_id).limit(limit + 1)
