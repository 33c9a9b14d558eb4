"""Sinks and whole-file scans as queries: what is written is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table, whole_files, write_partitioned


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Orders written in one folder a status and read again; the folder's name gives the status back."""
        where = f"{Scratch(spark, 'sink').path}/{kind}"
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
        write_partitioned(orders, where, "o_orderstatus", kind)
        return spark.read.format(kind).schema(orders.schema).load(where).select("o_orderkey", "o_orderstatus", "o_totalprice")

    return run


def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one text file each, read as whole files with their names."""
    where = f"{Scratch(spark, 'whole').path}/text"
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    nations.repartition("key").write.partitionBy("key").text(where)
    text = spark.read.text(where, wholetext=True)
    return text.select(F.col("key").cast("int").alias("n_nationkey"), F.split("value", "\n")[0].alias("n_name"), F.split("value", "\n")[1].cast("int").alias("n_regionkey"))


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as bytes, with their lengths."""
    where = f"{Scratch(spark, 'binary').path}/text"
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    nations.repartition("key").write.partitionBy("key").text(where)
    files = whole_files(spark, where).where(F.col("path").endswith(".txt"))
    return files.select(F.regexp_extract("path", "key=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.rtrim(F.col("content").cast("string"), F.lit("\n")).alias("n_name"), F.col("length").alias("bytes"))


QUERIES = {"sink_parquet": _round_trip("parquet"), "sink_json": _round_trip("json"), "sink_csv": _round_trip("csv"), "scan_whole_text": whole_text, "scan_binary": binary_files}
SQL = {f"sink_{kind}": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders" for kind in ("parquet", "json", "csv")} | {
    "scan_whole_text": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "scan_binary": "SELECT n_nationkey, n_name, (strlen(n_name) + 1)::BIGINT AS bytes FROM nation",
}
