"""Bucketed tables: rows dealt and sorted by a key once, when they are written, so that joins and aggregates on the key need no exchange later."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table

#: Rows of a bucket, on the average; the least buckets, and the most, which is Spark's own bound.
ROWS, LEAST, MOST = 500_000, 8, 100_000


class Buckets:
    """Tables of one number of buckets in one folder of the shared directory, under names of their own; they are gone when the session's JVM ends."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.scratch = spark, buckets, Scratch(spark, "buckets")

    @classmethod
    def of(cls, *tables: DataFrame) -> Buckets:
        """As many buckets as the largest of these tables needs for ROWS rows in each, so that a task's rows do not grow with the table."""
        rows = max(df.count() for df in tables)
        return cls(tables[0].sparkSession, min(MOST, max(LEAST, -(-rows // ROWS))))

    def write(self, df: DataFrame, *keys: str) -> DataFrame:
        """df as a table whose rows are in buckets by keys, sorted by them. Rows are dealt by the same hash first, so a bucket is one file, and none is empty of order.
        Rows with null keys are a key of their own. A key that very many rows share is one bucket: deal such tables by further columns."""
        name = f"tessera_{uuid.uuid4().hex}"
        dealt = df.repartition(self.buckets, *keys)
        dealt.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.scratch.path}/{name}").saveAsTable(name)
        return self.spark.table(name)


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan of df has before it is run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines, joined and summed by order without an exchange: lines, and their price in cents, of each order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.round(100 * F.col("l_extendedprice")).cast("long").alias("cents"))
    into = Buckets.of(orders, lines)
    orders, lines = into.write(orders, "key"), into.write(lines, "key")
    both = orders.hint("merge").join(lines, "key").groupBy("key", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return both.select(F.col("key").alias("o_orderkey"), "o_orderpriority", "n", "cents")


QUERIES = {"join_bucketed": bucketed_join}
SQL = {"join_bucketed": "SELECT o_orderkey, o_orderpriority, count(*) AS n, sum(round(100 * l_extendedprice)::BIGINT)::BIGINT AS cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"}
