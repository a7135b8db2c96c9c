"""Arrow batches of bounded bytes between the JVM and Python workers, and what workers do with them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are turned into Python objects at once in a worker; a longer single row is handled alone.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
KINDS = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}


def byte_size(value: str) -> int:
    """Bytes of a setting such as 8388608, 64m or 1g."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", value.strip().lower())
    if not m:
        raise ValueError(f"not a size: {value}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def bound_batches(spark: SparkSession | None = None) -> None:
    """Batches of BATCH_BYTES at most, for the given or else the active session: its setting is lowered where it is larger or unbounded."""
    spark = spark or SparkSession.getActiveSession()
    if spark and not 0 < byte_size(spark.conf.get(ARROW_BYTES)) <= BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes; a worker gives freed memory back after each partition.

    Workers are reused, so what one partition's caches leave in the allocators would stay beside the next one's.
    """
    bound_batches(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def release() -> None:
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """Gives what the allocators hold unused back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def parts(values: pa.RecordBatch | pa.Array, limit: int = SLICE_BYTES) -> Iterator:
    """Slices of a batch or an array, of about `limit` bytes where its rows are alike, or one row."""
    n = len(values)
    step = max(1, min(n, n * limit // max(1, values.nbytes)))
    for at in range(0, n, step):
        yield values.slice(at, step)


def in_groups(df: DataFrame, key: str, order: list, run: Callable[[Iterator[dict]], dict], schema: str, size: str) -> DataFrame:
    """A row of schema for each value of key: run gets the group's rows one by one, in order. size: the column whose bytes bound a batch of results.

    Rows are sorted in the JVM, which spills, and groups follow each other through bounded batches: a worker holds a slice of rows and what run keeps of one group.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in parts(batch):
                yield from part.to_pylist()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for _, group in groupby(rows(batches), lambda row: row[key]):
            made.append(run(group))
            held += len(made[-1][size]) + 64
            if held >= SLICE_BYTES:
                yield as_batch(made, schema)
                made, held = [], 0
        if made:
            yield as_batch(made, schema)

    return in_arrow(df.repartition(key).sortWithinPartitions(key, *order), grouped, schema)


def as_batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a flat schema in DDL."""
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array((r[name] for r in rows), KINDS[kind], size=len(rows)) for name, kind in fields], [name for name, _ in fields])
