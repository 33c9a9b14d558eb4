"""Structured Streaming over the events table: watermark, windows, sessions, dedup and stream-stream join.

Each query runs the stream once over what is there (availableNow) into a table of the shared folder, and returns
that table. `ts` has no zone; a watermark needs TIMESTAMP, so it is cast, in UTC.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. The table is one file or a folder of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream has written when all that is there now has been read."""
    spark, where = df.sparkSession, Scratch(df.sparkSession, "stream").path
    q = df.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/out")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed."""
    e = source(spark, sf_dir).withWatermark("ts", "1 hour")
    return run_once(e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = source(spark, sf_dir).withWatermark("ts", "1 hour")
    return run_once(e.groupBy(F.window("ts", "1 day", "6 hours")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = source(spark, sf_dir).withWatermark("ts", "1 hour")
    return run_once(e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, and once goes out."""
    e = source(spark, sf_dir).withWatermark("ts", "1 hour")
    return run_once(e.union(e).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = source(spark, sf_dir).where("event_type = 'click'").selectExpr("event_id AS click", "user_id AS u", "ts AS ta").withWatermark("ta", "1 hour")
    b = source(spark, sf_dir).where("event_type = 'purchase'").selectExpr("event_id AS purchase", "user_id AS v", "ts AS tb").withWatermark("tb", "1 hour")
    return run_once(a.join(b, F.expr("u = v AND tb BETWEEN ta AND ta + INTERVAL 1 HOUR")).select("click", "purchase"))


def into_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, complete, in a table in memory: they are as many as there are kinds."""
    name = f"tessera_{uuid.uuid4().hex}"
    q = source(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as in tumbling, when a later file brings the first two days' events again, long after the watermark has passed them: they are left out."""
    scratch = Scratch(spark, "late")
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    e.coalesce(1).write.parquet(f"{scratch.path}/in")
    first = e.agg(F.min("ts")).first()[0]
    again = e.where(F.col("ts") < F.lit(first).cast("timestamp_ntz") + F.expr("INTERVAL 2 DAYS"))
    e.where("false").coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")  # rows are held against the watermark before the last batch's
    again.coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    days = s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return run_once(days.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_tumbling": tumbling,
    "stream_sliding": sliding,
    "stream_sessions": sessions,
    "stream_dedup": deduplicated,
    "stream_join": joined,
    "stream_memory": into_memory,
    "stream_late": late,
}
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
SQL = {
    "stream_tumbling": f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {_CLOSED}",
    "stream_sliding": f"SELECT start, count(*) AS n FROM (SELECT ts, unnest([b, b - INTERVAL 6 HOUR, b - INTERVAL 12 HOUR, b - INTERVAL 18 HOUR]) AS start FROM (SELECT ts, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS b FROM events)) GROUP BY start HAVING start + INTERVAL 1 DAY <= {_CLOSED}",
    "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_memory": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_late": f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {_CLOSED}",
    # sessions that the watermark has closed: their last event is at least the gap and the watermark's delay old
    "stream_sessions": f"SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}",
    "stream_join": "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND epoch_us(p.ts) - epoch_us(c.ts) BETWEEN 0 AND 3600000000",
}
