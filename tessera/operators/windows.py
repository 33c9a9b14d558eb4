"""Window figures over keys with very many rows: ranks from counts, row numbers and exact percentiles in two levels.

A built-in window sorts all rows of a key in one task. Here the order is cut into buckets, at bounds taken from approximate
percentiles; rows are numbered within (key, bucket), and counts of buckets give what comes before. Bounds decide the balance only, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table


def ranks_by_counts(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with r, d, p, c: rank, dense_rank, percent_rank and cume_dist within key, from a count of each (key, order). The counts are
    made before the shuffle; the window runs over one row for each distinct value, and the join back sends no row of a key to one task."""
    counts = df.groupBy(key, order).agg(F.count("*").alias("n"))
    w = W.partitionBy(key).orderBy(order)
    upto, all_ = F.sum("n").over(w), F.sum("n").over(W.partitionBy(key))
    told = counts.select(
        F.col(key).alias("__k"),
        F.col(order).alias("__o"),
        (upto - F.col("n") + 1).alias("r"),
        F.row_number().over(w).cast("long").alias("d"),
        F.when(all_ > 1, (upto - F.col("n")) / (all_ - 1)).otherwise(0.0).alias("p"),
        (upto / all_).alias("c"),
    )
    return df.join(told, F.col(key).eqNullSafe(F.col("__k")) & F.col(order).eqNullSafe(F.col("__o"))).drop("__k", "__o")


def row_numbers(df: DataFrame, key: str, order: str, buckets: int | None = None) -> DataFrame:
    """df with rn, from 1 on in the order of `order` within key (nulls first, equal values in any order), and n, the rows of key."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    cut = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array(F.lit(None).cast(dict(df.dtypes)[order]))
    df = df.withColumn("__bucket", F.coalesce(F.size(F.filter(cut, lambda b: b <= F.col(order))), F.lit(0)))
    sums = df.groupBy(key, "__bucket").agg(F.count("*").alias("__c"))
    w = W.partitionBy(key)
    sums = sums.select(F.col(key).alias("__k"), F.col("__bucket").alias("__b"), (F.sum("__c").over(w.orderBy("__bucket")) - F.col("__c")).alias("__before"), F.sum("__c").over(w).alias("n"))
    own = F.row_number().over(W.partitionBy(key, "__bucket").orderBy(F.col(order).asc_nulls_first()))
    out = df.withColumn("__own", own).join(sums, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bucket") == F.col("__b")))
    return out.withColumn("rn", F.col("__own") + F.col("__before")).drop("__bucket", "__own", "__k", "__b", "__before")


def numbered(df: DataFrame, order: list[str | Column], scratch: Scratch | None = None) -> DataFrame:
    """df with place: a row's number, from 0 on, in the order of all rows; rows that are equal in order take any. No task sees more than its range: rows are
    sorted over ranges of the order and written, and the counts of the ranges, one number each, give what comes before. A value that very many rows share needs further
    columns in order, or its rows are one range."""
    scratch = scratch or Scratch(df.sparkSession, "numbered")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.write(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.part)  # a row a range
    before = [0]
    for r in sizes:
        before.append(before[-1] + r.n)
    starts = df.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before, strict=False)], "__part long, __before long")
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("place", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def percentiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key and q1, q2, ...: exact percentiles of the values that are not null, interpolated, from the one or two rows beside each rank."""
    rows = row_numbers(df.select(key, value).where(F.col(value).isNotNull()), key, value)
    at = [F.lit(q) * (F.col("n") - 1) + 1 for q in shares]
    near = rows.where(F.array_contains(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])), F.col("rn")))
    low = [F.max(F.when(F.col("rn") == F.floor(x), F.col(value))) for x in at]
    high = [F.max(F.when(F.col("rn") == F.ceil(x), F.col(value))) for x in at]
    part = [F.max(x - F.floor(x)) for x in at]
    return near.groupBy(key).agg(*[(a + (b - a) * c).alias(f"q{k}") for k, (a, b, c) in enumerate(zip(low, high, part, strict=True), 1)])


def percentiles_disc(df: DataFrame, key: str, value: str, shares: list[int]) -> DataFrame:
    """key and q1, q2, ...: of the values that are not null the one at the rank of each share (in hundredths), rounded up, without interpolation."""
    rows = row_numbers(df.select(key, value).where(F.col(value).isNotNull()), key, value)
    at = [F.greatest(F.lit(1), F.floor((F.col("n") * q + 99) / 100)) for q in shares]
    near = rows.where(F.array_contains(F.array(*at), F.col("rn").cast("long")))
    return near.groupBy(key).agg(*[F.max(F.when(F.col("rn") == x, F.col(value))).alias(f"q{k}") for k, x in enumerate(at, 1)])


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = row_numbers(ranks_by_counts(orders, "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderkey")
    size, more = F.floor(F.col("n") / 4), F.col("n") % 4  # the first `more` tiles have a row more
    tile = F.when(F.col("rn") <= more * (size + 1), F.ceil(F.col("rn") / (size + 1))).otherwise(more + F.ceil((F.col("rn") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return out.select("o_orderkey", "r", "d", F.round("p", 8).alias("p"), F.round("c", 8).alias("c"), tile.cast("long").alias("q"))


def percentile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = percentiles(table(spark, sf_dir, "events"), "event_type", "value", [0.25, 0.5])
    return out.select("event_type", F.round("q1", 6).alias("q1"), F.round("q2", 6).alias("q2"))


def median_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", [0.5]).select("l_returnflag", F.col("q1").alias("mid"))


def max_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each return flag the orders with the dearest and cheapest line, the least order, and the exact median of the quantities, in two levels."""
    lines = table(spark, sf_dir, "lineitem")
    by = F.struct("l_extendedprice", "l_orderkey")
    ends = lines.groupBy("l_returnflag").agg(F.max_by("l_orderkey", by).alias("top"), F.min_by("l_orderkey", by).alias("bottom"), F.min("l_orderkey").alias("low"))
    mid = percentiles(lines, "l_returnflag", "l_quantity", [0.5]).select(F.col("l_returnflag").alias("flag"), F.col("q1").alias("mid"))
    return ends.join(mid, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")


def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their label, those without one last, and of their id: each with its place."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id", "left")
    return numbered(rows, [F.col("q").asc_nulls_last(), "doc_id"])


QUERIES = {"ranks": ranks, "percentile_exact": percentile_exact, "median_two_level": median_quantity, "max_by_median": max_by_median, "sort_nulls": sort_nulls}
SQL = {
    "ranks": "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
    "max_by_median": "SELECT l_returnflag, arg_max(l_orderkey, {'a': l_extendedprice, 'b': l_orderkey}) AS top, arg_min(l_orderkey, {'a': l_extendedprice, 'b': l_orderkey}) AS bottom, min(l_orderkey) AS low, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag",
    "sort_nulls": "SELECT d.doc_id, l.quality AS q, row_number() OVER (ORDER BY l.quality ASC NULLS LAST, d.doc_id) - 1 AS place FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "percentile_exact": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2 FROM events GROUP BY event_type",
    "median_two_level": "SELECT l_returnflag, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag",
}
