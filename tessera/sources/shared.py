"""Tables in the folder that all executors share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset a local folder in local mode and the warehouse on a cluster."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


class Scratch:
    """A folder of written tables, removed when the session's JVM ends; tables that are read no more can be dropped before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
