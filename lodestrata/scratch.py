"""Intermediate tables in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a folder of our own, on a local master only: elsewhere it would not be shared."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def store(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Collects the driver's garbage between parts of a long chain of queries, as Spark's cleaner does each half hour.

    Plans, shuffle files and broadcasts of ended queries go only then, and the driver's heap shrinks to what is in use.
    """
    gc.collect()
    spark._jvm.System.gc()
