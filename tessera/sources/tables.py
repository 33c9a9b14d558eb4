"""Tables of a data folder as DataFrames and, for SQL, as temporary views; sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """query over the tables that it names; each is a view only while the query is analysed."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", query)]
    return spark.sql(_named(query, used), **{t: table(spark, sf_dir, t) for t in used})


def _named(query: str, used: list[str]) -> str:
    """Table names after FROM, JOIN or TABLE as parameters."""
    query = query.replace("{", "{{").replace("}", "}}")
    return re.sub(rf"(?i)\b(from|join|table)\s+({'|'.join(used)})\b", r"\1 {\2}", query) if used else query


def whole_files(spark: SparkSession, where: str) -> DataFrame:
    """Path, size and content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)


def write_partitioned(df: DataFrame, where: str, by: str, kind: str = "parquet") -> None:
    """One folder for each value of `by`; rows are dealt by it first, with a salt, so each folder gets few files."""
    from pyspark.sql import functions as F

    df.repartition(F.col(by), F.pmod(F.spark_partition_id(), F.lit(8))).write.mode("overwrite").partitionBy(by).format(kind).save(where)
