"""Reachability over a table of edges, and unions and samples that SQL has no words for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node and hops: the nodes that can be reached from those of starts (node) along edges (a, b), and the fewest edges on the way.

    Semi-naive: each round follows the edges of the nodes that are new only, and leaves out what was seen before, so cycles end; rounds are
    written tables, and stop when one finds nothing. Edges are shuffled by their start with a salt, to which new nodes, which are unique, are sent each,
    so a node with very many edges is many tasks. Null nodes are reached by nothing; a start without edges reaches itself; repeated edges count once.
    """
    scratch, salts = Scratch(edges.sparkSession, "reachable"), 8
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("salt"))
    e = scratch.write(e.distinct().repartition("a", "salt"), "edges")
    new = scratch.write(starts.select("node").where("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)), "round-0")
    seen, k = new, 0
    while new.limit(1).count():
        k += 1
        ahead = new.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        found = e.join(ahead, ["a", "salt"]).select(F.col("b").alias("node")).distinct()
        new = scratch.write(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)), f"round-{k}")
        seen = seen.union(new)
    return seen


def reachable_through(entries: DataFrame, exits: DataFrame, starts: DataFrame) -> DataFrame:
    """node and hops as in reachable, where an edge leads from a to b if an exit of a (node, hub) is an entry of b (node, hub).

    The edges are never made: they are as many as the product of a hub's exits and entries. Hubs are reached instead, along the distinct (entry, exit) of each node, which are
    at most as many as rows where a node has one of either; then every node is met once by its entries. Null nodes and hubs lead nowhere.
    """
    scratch = Scratch(entries.sparkSession, "through")
    entries, exits = (df.where("node IS NOT NULL AND hub IS NOT NULL").select("node", "hub") for df in (entries, exits))
    first = scratch.write(starts.select("node").where("node IS NOT NULL").distinct(), "starts")
    between = entries.withColumnRenamed("hub", "a").join(exits.withColumnRenamed("hub", "b"), "node").select("a", "b").distinct()
    hubs = reachable(between, exits.join(first, "node", "left_semi").select(F.col("hub").alias("node")))
    met = entries.join(hubs.select(F.col("node").alias("hub"), F.col("hops") + 1), "hub").toDF("hub", "node", "hops").select("node", "hops")
    return met.union(first.select("node", F.lit(0))).groupBy("node").agg(F.min("hops").alias("hops"))


def reachable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that can be reached from those of sizes up to 5 by steps to a part of the same brand that is five larger."""
    p = table(spark, sf_dir, "part")
    hub = lambda size: F.when(F.col("p_brand").isNotNull() & F.col("p_size").isNotNull(), F.struct(F.col("p_brand").alias("brand"), size.cast("long").alias("size"))).alias("hub")
    at = lambda size: p.select(F.col("p_partkey").alias("node"), hub(size))
    return reachable_through(at(F.col("p_size")), at(F.col("p_size").cast("long") + 5), p.where("p_size <= 5").select(F.col("p_partkey").alias("node")))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by the names of their columns, which stand in another order; what one side lacks is null."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS k", "s_name AS name")
    return s.unionByName(c, allowMissingColumns=True)


def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders by a seed: how many orders there are, whether the sample is within five standard errors of a tenth, is the same when drawn again,
    another by another seed, and has no order twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    draw = lambda seed: o.sample(0.1, seed)
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("o_orderkey"), F.lit(1_000_003))).alias("h"), F.count_distinct("o_orderkey").alias("d"))
    one, again, other = (digest(draw(seed)).toDF(*[f"{c}{k}" for c in "nhd"]) for k, seed in enumerate((3, 3, 4)))
    all_ = o.agg(F.count("*").alias("orders"))
    told = all_.join(one).join(again).join(other)  # a row each
    near = F.abs(F.col("n0") - 0.1 * F.col("orders")) <= 5 * F.sqrt(0.09 * F.col("orders"))
    return told.select("orders", near.alias("near"), ((F.col("n0") == F.col("n1")) & (F.col("h0") == F.col("h1"))).alias("again"), (F.col("h0") != F.col("h2")).alias("other"), (F.col("n0") == F.col("d0")).alias("once"))


QUERIES = {"reachable_parts": reachable_parts, "union_by_name": union_by_name, "sample_seeded": sample_seeded}
SQL = {
    "reachable_parts": "WITH RECURSIVE t(node, hops) AS (SELECT p_partkey, 0 FROM part WHERE p_size <= 5 UNION SELECT b.p_partkey, t.hops + 1 FROM t JOIN part a ON a.p_partkey = t.node JOIN part b ON b.p_brand = a.p_brand AND b.p_size = a.p_size + 5) SELECT node, hops FROM t",
    "union_by_name": "SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
    "sample_seeded": "SELECT count(*) AS orders, true AS near, true AS again, true AS other, true AS once FROM orders",
}
