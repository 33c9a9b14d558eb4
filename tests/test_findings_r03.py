"""The findings of the third round: small inputs on which the queries failed before."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs, ordered
from tessera.plans import catalog
from tessera.sources import bucketed
from tessera.streaming import stateful


def same_as_sql(spark, name, folder, **frames):
    """The query gives its SQL's rows over these tables, which are written to folder."""
    c = duckdb.connect()
    for table, df in frames.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want, key=repr)
    return rows


def test_range_frame_rounds_as_its_sql(spark, tmp_path):
    prices = [0.5, 1.5, 2.5, 10000.4, 10000.5, 10000.6, 10001.5, 10002.5, 20000.5, 20001.7, -0.5, -1.5, None]
    orders = spark.createDataFrame([(i, k, x) for k in (1, 2, None) for i, x in enumerate(prices[: 13 if k else 9], 100 * (k or 9))], "o_orderkey long, o_custkey long, o_totalprice double")
    same_as_sql(spark, "range_frame", tmp_path, orders=orders)


def sketches_by_order(df):
    """Aggregations of df's plan that keep a sketch for each order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Aggregate" in x and "l_orderkey" in x.split("functions=")[0] and ("approx_count_distinct" in x or "hll_sketch_agg" in x) and "functions=" in x]


def test_no_sketch_for_each_order(spark):
    for name in ("approx_within_bound", "distinct_sketch_rollup"):
        assert not sketches_by_order(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_approx_within_bound_with_nulls(spark, tmp_path):
    lines = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (None, "A"), (3, None), (4, None), (None, "N")], "l_orderkey long, l_returnflag string")
    assert same_as_sql(spark, "approx_within_bound", tmp_path, lineitem=lines, orders=spark.range(1)) == [("A", 2, True), ("N", 0, True), (None, 2, True)]


def test_buckets_grow_with_the_table(spark, monkeypatch):
    small, large = spark.range(90), spark.range(1000)
    assert bucketed.Buckets.of(small, large).buckets == bucketed.LEAST
    monkeypatch.setattr(bucketed, "ROWS", 50)
    into = bucketed.Buckets.of(small, large)
    assert into.buckets == 20
    both = into.write(small, "id").hint("merge").join(into.write(large, "id"), "id")
    assert bucketed.exchanges(both) == 0 and both.count() == 90 and both.rdd.getNumPartitions() == 20


def test_approx_percentile_gives_the_values(spark, tmp_path):
    rows = [("a", float(x)) for x in range(250)] + [("b", x) for x in (3.0, 1.0, 1.0, 2.0, None)] + [("c", 7.0), ("d", None), (None, 2.0), (None, 4.0)] + [("e", float(x % 4)) for x in range(10)]
    got = same_as_sql(spark, "approx_percentile", tmp_path, events=spark.createDataFrame(rows, "event_type string, value double"))
    assert ("a", 124.0, 224.0, 250, True, True) in got and ("d", None, None, 0, True, True) in got


@pytest.mark.parametrize("strip", [3, 20, 100_000])
def test_inequality_counts(spark, strip):
    """Ties, values that a third of the rows share, nulls, NaN, infinities, repeated ids, with one strip and with many."""
    rnd = random.Random(strip)
    value = lambda: rnd.choice([None, 1.0, 1.0, 1.0, float("nan"), float("inf"), rnd.random(), float(rnd.randrange(5)), 0.0, -0.0])
    left, right = [(i % 140 - 70, value(), value()) for i in range(150)], [(i - 60, value(), value()) for i in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    want = {}
    for a in left:
        for b in right:
            if None not in a + b and a[1] < b[1] and a[2] > b[2]:
                n, last = want.get(a[0], (0, b[0]))
                want[a[0]] = n + 1, max(last, b[0])
    got = ordered.inequality_counts(frame(left), frame(right), strip).collect()
    assert {r.id: (r.n, r["last"]) for r in got} == want and len(got) == len(want) > 20
    assert ordered.inequality_counts(frame(left).limit(0), frame(right)).count() == 0 and ordered.inequality_counts(frame(left), frame(right).limit(0)).count() == 0


def test_join_inequality_makes_no_pairs(spark, tmp_path, monkeypatch):
    """Every order pairs with every later one: 4,498,500 pairs, which are counted without being made."""
    orders = spark.range(3000).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.col("id") * 86_400).cast("timestamp_ntz").alias("o_orderdate"), F.pow(F.lit(1.05), -F.col("id") * 2).alias("o_totalprice"))
    orders = orders.union(orders.where("o_orderkey < 100").selectExpr("o_orderkey + 5000", "o_orderdate", "o_totalprice * 1e9"))
    monkeypatch.setattr(ordered, "inequality_pairs", None)
    got = same_as_sql(spark, "join_inequality", tmp_path, orders=orders)
    assert sum(r[1] for r in got) > 3_000_000


def test_reachable_through_hubs(spark):
    rnd = random.Random(4)
    ends = lambda n: [(rnd.choice([None, *range(40)]), rnd.choice([None, *"abcdefghijkl"])) for _ in range(n)]
    entries, exits, starts = [*ends(45), (50, "z")], [*ends(30), (50, "a"), (51, "b")], [(3,), (50,), (51,), (None,), (60,), (3,)]
    edges = [(a, b) for a, h in exits for b, k in entries if None not in (a, b, h) and h == k]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in graphs.reachable_through(frame(entries, "node long, hub string"), frame(exits, "node long, hub string"), frame(starts, "node long")).select("node", "hops").collect()]
    hops = {n: 0 for n, in starts if n is not None}
    for k in range(1, 60):
        hops |= {b: k for a, b in edges if hops.get(a) == k - 1 and b not in hops}
    assert sorted(got) == sorted(hops.items()) and max(hops.values()) > 2


def test_reachable_parts_makes_no_edges(spark, tmp_path, monkeypatch):
    """900 parts of one brand and three sizes: 180,000 edges of parts, three of hubs."""
    seen, plain = [], graphs.reachable
    monkeypatch.setattr(graphs, "reachable", lambda edges, starts: seen.append(edges.count()) or plain(edges, starts))
    part = spark.range(900).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 100 != 7, "b").alias("p_brand"), (3 + 5 * (F.col("id") % 3)).cast("int").alias("p_size"))
    got = same_as_sql(spark, "reachable_parts", tmp_path, part=part.union(spark.createDataFrame([(2000, "c", 1), (2001, "b", None), (2002, "c", 11)], "p_partkey long, p_brand string, p_size int")))
    assert len(got) > 800 and seen == [3 + 2]


class _Handle:
    """A handle whose state is one value, and which counts what is asked of it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_sessions_ask_for_state_once_a_batch():
    """Many users and events in a call: one read, one write and one timer; users without an id are a user."""
    handle, sessions = _Handle(), stateful.Sessions(1000)
    sessions.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["at", "event_id", "known", "user", "event_type", "cents"])
    first = [(10_000_000 + 1000 * u, u, u != 7, u if u != 7 else 0, "a", u) for u in range(50)]
    again = [(10_500_000, 100 + u, True, u, "b", 1) for u in range(5)] + [(12_000_000, 200, False, 0, "c", 3)]
    assert not list(sessions.handleInputRows((1,), iter([frame(first)]), None)) and handle.calls == 2 and handle.timers == {11_000}
    told = pd.concat(sessions.handleInputRows((1,), iter([frame(again[3:]), frame(again[:3])]), None))
    assert handle.calls == 4 and handle.timers == {11_005} and told["user_id"].isna().all() and told[["n", "top", "total", "before"]].values.tolist() == [[1, "a", 0.07, 0]]
