"""User-defined functions: vectorised scalars, map batches, grouped aggregates, table functions and SQL functions.

Built-in functions come first everywhere else; these queries show the forms for what built-ins cannot express. Python ones see Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from tessera.sources.tables import table


def vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function over batches of values; null where the balance is null."""

    @pandas_udf("double")
    def half(x: pd.Series) -> pd.Series:
        return x / 2

    return table(spark, sf_dir, "customer").select("c_custkey", half("c_acctbal").alias("half"))


def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of embeddings, made from Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(b.column(1))], ["vec_id", "n"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, n int")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over all values of a group at once: a group's values must fit a task, so parts are spread over their key and size first,
    and the figures of the parts, which are few, are merged."""

    @pandas_udf("long")
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    parts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(spread("p_size").alias("s"))
    return parts.groupBy("p_brand").agg(F.max("s").alias("spread"))


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from a row: the digits of a key, by a table function in a lateral join."""

    @udtf(returnType="pos int, digit int")
    class Digits:
        def eval(self, key: int):
            for k, d in enumerate(str(key)):
                yield k, int(d)

    spark.udtf.register("tessera_digits", Digits)
    return spark.sql("SELECT s.s_suppkey, d.pos, d.digit FROM {s} s, LATERAL tessera_digits(s.s_suppkey) d", s=table(spark, sf_dir, "supplier"))


def table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over a table's partitions in their order: runs of events of one kind of a user on a day. Its rows are named after the columns that it is
    given, which analyze sees before it is run; the run at hand is its state along a partition, and its last run goes out when the partition ends."""

    class Runs:
        def __init__(self):
            self.key, self.kind, self.first, self.n = None, None, None, 0

        @staticmethod
        def analyze(rows, key, kind, at):
            from pyspark.sql.functions import AnalyzeResult
            from pyspark.sql.types import LongType, StructType

            given = {f.name: f.dataType for f in rows.dataType.fields}
            out = StructType().add("key", given[key.value]).add(kind.value, given[kind.value]).add("first", given[at.value]).add("n", LongType())
            return AnalyzeResult(schema=out)

        def eval(self, rows, key, kind, at):
            if self.n and rows[kind] != self.kind:
                yield self.key, self.kind, self.first, self.n
                self.n = 0
            if not self.n:
                self.key, self.kind, self.first = rows[key], rows[kind], rows[at]
            self.n += 1

        def terminate(self):
            if self.n:
                yield self.key, self.kind, self.first, self.n

    spark.udtf.register("tessera_runs", udtf(Runs))
    query = "SELECT key AS user_id, event_type, first, n FROM tessera_runs(TABLE(SELECT user_id, event_type, event_id, to_date(ts) AS day FROM {e}) PARTITION BY (user_id, day) ORDER BY (event_id), 'user_id', 'event_type', 'event_id')"
    return spark.sql(query, e=table(spark, sf_dir, "events"))


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function in SQL, which is inlined into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN round(price * (1 - discount), 2)")
    return spark.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tessera_net(l_extendedprice, l_discount) > 1000 AS large FROM {l}", l=table(spark, sf_dir, "lineitem"))


QUERIES = {"udf_vectorised": vectorised, "udf_map_batches": map_batches, "udf_grouped": grouped, "udf_table": table_function, "udf_table_argument": table_argument, "udf_sql": sql_function}
SQL = {
    "udf_vectorised": "SELECT c_custkey, c_acctbal / 2 AS half FROM customer",
    "udf_map_batches": "SELECT vec_id, len(embedding)::INT AS n FROM embeddings",
    "udf_grouped": "SELECT p_brand, max(s)::BIGINT AS spread FROM (SELECT p_brand, max(p_size) - min(p_size) AS s FROM part GROUP BY p_brand, p_type) GROUP BY p_brand",
    "udf_table": "SELECT s_suppkey, pos::INT AS pos, CAST(substr(s_suppkey::VARCHAR, pos + 1, 1) AS INT) AS digit FROM (SELECT s_suppkey, unnest(range(length(s_suppkey::VARCHAR))) AS pos FROM supplier)",
    "udf_table_argument": "SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY event_id) AS run FROM events) GROUP BY user_id, ts::DATE, event_type, run",
    "udf_sql": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 2) > 1000 AS large FROM lineitem",
}
