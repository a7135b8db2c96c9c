"""Object store as a Parquet table of (tenant, key, content, mime_type), partitioned by tenant.

Point reads prune to the tenant's partition; batches of references join on the key, and only then is content read on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import parse_key

SCHEMA = "key string, content binary, mime_type string, tenant string"


class BlobNotFound(LookupError):
    pass


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def table(self) -> DataFrame:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.root)

    def read(self, refs: DataFrame) -> DataFrame:
        """Content of the wanted (tenant, key) rows."""
        return self.table().join(refs.select("tenant", "key").distinct(), ["tenant", "key"], "left_semi")

    def read_one(self, tenant: str, key: str) -> bytes:
        row = self.table().where((F.col("tenant") == tenant) & (F.col("key") == key)).select("content").first()
        if row is None:
            raise BlobNotFound(f"{tenant}/{key}")
        return bytes(row[0])

    def exists(self, refs: DataFrame) -> DataFrame:
        have = self.table().select("tenant", "key", F.lit(True).alias("found")).distinct()
        return refs.join(have, ["tenant", "key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def create(self, rows: DataFrame) -> None:
        """Write once: keys that are there already are left as they are."""
        new = rows.dropDuplicates(["tenant", "key"]).join(self.table().select("tenant", "key"), ["tenant", "key"], "left_anti")
        new.select("key", "content", "mime_type", "tenant").write.mode("append").partitionBy("tenant").parquet(self.root)

    def delete(self, tenant: str, key: str) -> None:
        """Rewrite the tenant's partition without the key; a missing key raises."""
        mine = self.table().where(F.col("tenant") == tenant)
        if not mine.where(F.col("key") == key).limit(1).count():
            raise BlobNotFound(f"{tenant}/{key}")
        # Written beside and swapped in: at every moment one whole copy is in the store's folder.
        fs, path = self._fs()
        here, beside, old = (f"{self.root}/{name}" for name in (f"tenant={tenant}", f"_new-{tenant}", f"_old-{tenant}"))
        mine.where(F.col("key") != key).drop("tenant").write.mode("overwrite").parquet(beside)
        fs.rename(path(here), path(old))
        if mine.sparkSession.read.parquet(beside).limit(1).count():
            fs.rename(path(beside), path(here))
        else:
            fs.delete(path(beside), True)
        fs.delete(path(old), True)

    def delete_tenant(self, tenant: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/tenant={tenant}"), True)

    def tenants(self) -> DataFrame:
        return self.table().select("tenant").distinct()

    def containers(self, tenant: str) -> DataFrame:
        return self.table().where((F.col("tenant") == tenant) & F.col("key").endswith("_")).select("key", parse_key(F.col("key")).alias("ref"))
