"""Sketches, ordered joins, the vector index, reachability, bucketed tables and state over many batches, on small frames and against plain versions."""

import collections
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import extensions
from tessera.operators import graphs, ordered, sketches, vectors, windows
from tessera.sources import bucketed
from tessera.sources.shared import Scratch
from tessera.streaming import stateful

SF = "/root/testdata/sf0.001"


# sketches


def test_distinct_states_merge(spark):
    df = spark.range(0, 200_000, 1, 6).select(F.pmod("id", F.lit(7)).cast("int").alias("day"), F.pmod("id", F.lit(3)).cast("int").alias("kind"), (F.col("id") % 100_000).alias("v"))
    df = df.union(spark.createDataFrame([(0, 9, None)], "day int, kind int, v long"))
    states = sketches.distinct_states(df, ["day", "kind"], "v")
    up = {r.kind: r.n for r in sketches.rolled_up(states, [["kind"], []], "distinct").select("kind", F.hll_sketch_estimate("state").alias("n")).collect()}
    exact = {r.kind: r.n for r in df.groupBy("kind").agg(F.count_distinct("v").alias("n")).collect()} | {None: 100_000}
    assert set(up) == set(exact) and up[9] == 0
    assert all(abs(up[k] - n) <= sketches.DISTINCT_ERROR * n for k, n in exact.items())
    assert states.select(F.max(F.octet_length("state"))).first()[0] <= sketches.DISTINCT_BYTES
    assert sketches.rolled_up(states.limit(0), [["kind"]], "distinct").count() == 0


def test_quantile_states_have_bounded_size(spark):
    sizes = []
    for n in (1000, 100_000, 2_000_000):
        df = spark.range(0, n, 1, 8).select(F.pmod("id", F.lit(20)).alias("day"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
        states = Scratch(spark, "t").write(sketches.quantile_states(df, ["day"], "v"), "states")
        up = Scratch(spark, "t").write(sketches.rolled_up(states, [[]], "quantile"), "up")
        sizes.append(up.select(F.octet_length("state")).first()[0])
        told = up.select(F.inline(F.arrays_zip(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99)).alias("q"), F.kll_sketch_get_quantile_double("state", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("v")))).withColumn("k", F.lit(None).cast("int"))
        for r in sketches.ranks(df.withColumn("k", F.lit(1)), "k", "v", told).collect():
            assert r.n == n and max(r.least - r.q, r.q - r.most, 0) <= sketches.RANK_ERROR
    assert sizes[2] < 2 * sizes[1] and max(sizes) <= sketches.QUANTILE_BYTES


# joins by order


def plain_asof(left, right, tolerance):
    out = []
    for i, k, t in left:
        rows = [(u, j) for j, m, u in right if None not in (j, m, u, k, t) and m == k and u <= t]
        u, j = max(rows, default=(None, None))
        out.append((i, None, None) if j is None or tolerance is not None and t - u > tolerance else (i, j, t - u))
    return out


@pytest.mark.parametrize(("keys", "tolerance"), [(1, None), (1, 40), (6, 25), (200, None)])
def test_asof(spark, keys, tolerance):
    rnd = random.Random(keys)
    row = lambda i, span: (i, rnd.choice([None, *range(keys), *range(keys)]), rnd.choice([None, *range(-span, span)]))
    left, right = [row(i % 480, 300) for i in range(500)], [row(i % 190, 300) for i in range(200)] + [(None, 0, 5)]
    frame = lambda rows, parts: spark.createDataFrame(rows, "id long, key long, at long").repartition(parts)
    got = ordered.asof(frame(left, 3), frame(right, 2), tolerance).collect()
    key = lambda r: tuple(x if x is not None else -999 for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_asof(left, right, tolerance), key=key)
    assert ordered.asof(frame(left, 1).limit(0), frame(right, 1)).count() == 0
    assert ordered.asof(frame(left, 1), frame(right, 1).limit(0)).where("match IS NOT NULL").count() == 0


def test_asof_one_key_is_many_tasks(spark):
    left = spark.range(4000).select("id", F.lit(1).alias("key"), (F.col("id") * 10).alias("at"))
    right = spark.range(50).select("id", F.lit(1).alias("key"), (F.col("id") * 800 + 5).alias("at"))
    out = ordered.asof(left, right)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {(r.id, r.match) for r in out.collect()} == {(i, None if i == 0 else (10 * i - 5) // 800) for i in range(4000)}


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_inequality_pairs(spark, block):
    rnd = random.Random(block)
    row = lambda i: (i, rnd.choice([None, 1.0, float("nan"), rnd.random(), 3.0]), rnd.choice([None, 0.5, 2.0, rnd.random()]))
    left, right = [row(i % 140) for i in range(150)], [row(i) for i in range(120)]
    kind = "id long, x double, y double"
    got = collections.Counter(map(tuple, ordered.inequality_pairs(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), block).collect()))
    want = collections.Counter((a[0], b[0]) for a in left for b in right if None not in a + b and a[1] < b[1] and a[2] > b[2])
    assert got == want and sum(want.values()) > 300
    assert ordered.inequality_pairs(spark.createDataFrame([], kind), spark.createDataFrame(right, kind)).count() == 0


def test_inequality_plan_has_no_nested_loop(spark):
    plan = ordered.QUERIES["join_inequality"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# vectors


def test_vector_index(spark):
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in centres[i % 12]]) for i in range(1500)] + [(2000, None), (2001, [0.0] * 16)]
    rows += [(3000 + i, rows[0][1]) for i in range(20)]  # copies
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    queries = df.where("id % 100 = 0")
    index = vectors.VectorIndex(df)
    assert index.rows.count() == 1520 and {r.id for r in index.rows.collect()} == {i for i, v in rows if v and any(v)}
    exact = {(r.id, r.near): round(r.similarity, 9) for r in vectors.nearest_vectors(df, queries, 5).collect()}
    for probes, block in ((None, 2048), (max(1, len(index.centres) // 6), 50)):
        found = {(r.id, r.near): round(r.similarity, 9) for r in index.search(queries, 5, probes, block).collect()}
        best = collections.Counter(i for i, _ in found)
        assert set(best.values()) == {5}
        hit = sum(any(i == q and abs(s - exact[p]) < 1e-9 for (i, _), s in found.items()) for p in exact for q in (p[0],))
        assert hit >= 0.9 * len(exact)
    none = vectors.VectorIndex(df.where("id = 2000"))
    assert none.rows.count() == 0 and none.search(queries, 3).count() == 0


# order, reachability, buckets


def test_numbered(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3]), i) for i in range(300)]
    got = windows.numbered(spark.createDataFrame(rows, "q int, id long").repartition(4), [F.col("q").asc_nulls_last(), F.col("id").desc()]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert [(r.q, r.id) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(300))
    assert windows.numbered(spark.createDataFrame([], "q int"), ["q"]).count() == 0


def test_reachable(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (4, 4), (None, 7), (4, None), (1, 2), *((4, 100 + i) for i in range(60))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.hops for r in graphs.reachable(df, spark.createDataFrame([(1,), (9,), (None,), (1,)], "node long")).collect()}
    assert got == {1: 0, 9: 0, 2: 1, 3: 2, 4: 3} | {100 + i: 4 for i in range(60)}
    assert graphs.reachable(df, spark.createDataFrame([], "node long")).count() == 0


def test_bucketed_tables_join_without_exchange(spark):
    got = bucketed.bucketed_join(spark, SF)
    assert bucketed.exchanges(got) == 0
    assert bucketed.exchanges(spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_custkey").count()) == 1


def test_partitions_of_a_table_argument(spark):
    got = extensions.table_argument(spark, SF)
    assert got.columns == ["user_id", "event_type", "first", "n"] and dict(got.dtypes)["user_id"] == "bigint" and dict(got.dtypes)["event_type"] == "string"


# state


def test_sessions_over_batches_and_a_restart(spark):
    """A user whose session goes on from batch to batch and over the restart, one whose events come after a gap, and one whom only a timer ends."""
    scratch = Scratch(spark, "test")
    minute = 60_000_000
    batches = [[(1, 1, "a", 1.0, 0), (2, 2, "b", 2.5, 5)], [(3, 1, "b", 1.0, 20), (4, 3, "a", 0.1, 21)], [(5, 1, "b", 0.25, 40), (6, 2, "a", 1.0, 50)], [(7, 1, "a", 1.0, 60), (8, 2, "a", 2.0, 70)], [(9, 4, "z", 0.0, 600)]]
    kind = "event_id long, user_id long, event_type string, value double, ts timestamp"
    for part in (batches[:3], batches[3:]):
        for rows in part:
            spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, m long").select("event_id", "user_id", "event_type", "value", F.timestamp_micros((F.col("m") + 10_000) * minute).alias("ts")).coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")
        given = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in")
        stateful.run_on(stateful.sessions(given, 1_800_000, "1 hour"), scratch.path)
    out = spark.read.schema(stateful.SESSION).parquet(f"{scratch.path}/out").withColumn("m", F.unix_micros("start") / minute - 10_000).collect()
    assert sorted((r.user_id, r.m, r.n, r.top, r.total, r.before) for r in out) == [(1, 0, 4, "a", 3.25, 0), (2, 5, 1, "b", 2.5, 0), (2, 50, 2, "a", 3.0, 1), (3, 21, 1, "a", 0.1, 0)]


def test_state_that_lives_for_a_while(spark):
    """Within its time a kind is known over a restart; after it, it is new again."""
    scratch, kind = Scratch(spark, "test"), "event_id long, user_id long, event_type string"
    for rows, wait in (([(1, 1, "a"), (2, 1, "b"), (3, 2, "a")], 0), ([(4, 1, "a"), (5, 2, "b")], 0), ([(6, 1, "a"), (7, 2, "a")], 25)):
        time.sleep(wait)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")
        stateful.run_on(stateful.first_seen(spark.readStream.schema(kind).parquet(f"{scratch.path}/in"), 20_000), scratch.path, True)
    got = sorted((r.event_id, r.user_id, r.event_type) for r in spark.read.parquet(f"{scratch.path}/out").collect())
    assert got in ([(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (5, 2, "b"), (6, 1, "a"), (7, 2, "a")], [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 1, "a"), (5, 2, "b"), (6, 1, "a"), (7, 2, "a")])  # the second if a run took 20 seconds


def test_all_names_are_registered_once():
    from tessera.plans import catalog

    names = list(itertools.chain(catalog._TEXTS, *(m.QUERIES for m in catalog._MODULES)))
    assert len(names) == len(set(names)) and set(catalog.SQL) == set(names)
