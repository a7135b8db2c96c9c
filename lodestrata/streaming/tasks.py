"""Notifications, running state and lease timeouts over a stream of task rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tasks import COMPLETE, OPEN


def change_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files appended to the task log."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def notifications(log: DataFrame) -> DataFrame:
    """channel, task_id: new open tasks are available, completed ones completed."""
    channel = F.when(F.col("status") == OPEN, "task_available").when(F.col("status") == COMPLETE, "task_completed")
    return log.select(channel.alias("channel"), F.col("id").cast("string").alias("task_id")).where("channel is not null")


def overdue(claims: DataFrame, lease: str = "5 minutes", lateness: str = "1 minute") -> DataFrame:
    """Leases that no release closed in time, as windows over event time: task_id, claimed, released.

    claims(task_id, ts, kind: claim or release); the watermark bounds the state.
    """
    session = claims.withWatermark("ts", lateness).groupBy("task_id", F.session_window("ts", lease))
    return session.agg(F.count_if(F.col("kind") == "claim").alias("claimed"), F.count_if(F.col("kind") == "release").alias("released")).where("claimed > released").select("task_id", "claimed", "released")


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")


def fan_in(done: DataFrame, needed: DataFrame, parent: str, parts: str, sink: str, checkpoint: str) -> DataFrame:
    """parent, parts of the parents all of whose parts have arrived on the stream `done`.

    The stream only counts arrivals: each batch appends one row per parent to the sink, under its batch id, so a batch that
    runs again replaces what it wrote. The countdown is their sum against needed(parent, parts).
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(parent).agg(F.count(F.lit(1)).alias("arrived")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = done.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    kind = needed.schema[parent].dataType.simpleString()
    arrived = needed.sparkSession.read.schema(f"{parent} {kind}, arrived bigint, batch int").parquet(sink).groupBy(parent).agg(F.sum("arrived").alias("arrived"))
    return needed.join(arrived, parent).where(F.col("arrived") >= F.col(parts)).select(parent, parts)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Process what is there, exactly once per checkpoint, then stop."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
