"""Joins on a key and a range of time, in buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def interval_pairs(left: DataFrame, right: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Pairs with equal key whose times lie within `seconds`, right not before left. Both sides hold `id`, key and at.

    Time is cut in buckets of that length; a left row looks at its own and the next bucket, so the join is an
    equi-join on (key, bucket) and a key with very many rows is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    x = left.select(F.col("id").alias("a"), key, F.col(at).alias("ta")).withColumn("b", F.explode(F.array(bucket("ta"), bucket("ta") + 1)))
    y = right.select(F.col("id").alias("z"), key, F.col(at).alias("tz")).withColumn("b", bucket("tz"))
    micros = F.unix_micros(F.col("tz").cast("timestamp")) - F.unix_micros(F.col("ta").cast("timestamp"))
    return x.join(y, [key, "b"]).where(micros.between(0, seconds * 1_000_000)).select("a", "z")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda kind: e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "user_id", "ts")
    return interval_pairs(pick("click"), pick("purchase"), "user_id", "ts", 3600).select(F.col("a").alias("click"), F.col("z").alias("purchase"))


INTERVAL_SQL = "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND epoch_us(p.ts) - epoch_us(c.ts) BETWEEN 0 AND 3600000000"
QUERIES = {"join_interval": interval_join}
SQL = {"join_interval": INTERVAL_SQL}
