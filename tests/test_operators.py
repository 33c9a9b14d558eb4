"""Operators on small frames: nulls, ties, no rows, and more than one block or bucket."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, passages, vectors, windows
from tessera.sources import tables


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_row_numbers(spark, buckets):
    rnd = random.Random(buckets)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.0, 3.0, rnd.random()])) for _ in range(200)]
    got = windows.row_numbers(spark.createDataFrame(rows, "k string, v double"), "k", "v", buckets).collect()
    for key in ("a", "b", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.rn)
        assert [r.rn for r in own] == list(range(1, len(own) + 1)) and {r.n for r in own} == {len(own)}
        values = [(r.v is not None, r.v or 0) for r in own]
        assert values == sorted(values)
    assert windows.row_numbers(spark.createDataFrame([], "k string, v double"), "k", "v", buckets).count() == 0


def test_ranks_and_percentiles(spark):
    rows = [("a", 1, 5.0), ("a", 1, None), ("a", 2, 7.0), (None, 3, 1.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    got = {(r.k, r.o): (r.r, r.d, r.p, r.c) for r in windows.ranks_by_counts(df, "k", "o").collect()}
    assert got == {("a", 1): (1, 1, 0.0, 2 / 3), ("a", 2): (3, 2, 1.0, 1.0), (None, 3): (1, 1, 0.0, 1.0), ("b", None): (1, 1, 0.0, 1.0)}
    assert {(r.k, r.q1, r.q2) for r in windows.percentiles(df, "k", "v", [0.5, 1.0]).collect()} == {("a", 6.0, 7.0), (None, 1.0, 1.0)}


def test_nearest_vectors_in_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")

    def cosine(x, y):
        norm = sum(a * a for a in x) ** 0.5 * sum(a * a for a in y) ** 0.5
        return sum(a * b for a, b in zip(x, y, strict=True)) / norm if norm else None

    got = {}
    for r in vectors.nearest_vectors(df, df.where("id % 10 = 0"), 4, 16).collect():
        got.setdefault(r.id, {})[r["rank"]] = round(r.similarity, 9)
    for i, v in rows:
        if i % 10 == 0 and v and any(v):
            near = sorted((-round(s, 9) for j, w in rows if j != i and w and (s := cosine(v, w)) is not None))[:4]
            assert [-x for x in near] == [got[i][k] for k in (1, 2, 3, 4)]
    assert vectors.nearest_vectors(df.limit(0), df.limit(0), 4).count() == 0


@pytest.mark.parametrize("most", [100_000, 2, 0])
def test_contained(spark, monkeypatch, most):
    """By one automaton, and by runs of words with automata for the short passages."""
    monkeypatch.setattr(passages, "MOST_CHARS" if not most else "MOST_PASSAGES", most or 1)
    monkeypatch.setattr(passages, "HEAD", 20)
    long, short = "one two three four five six seven", "red fox"
    texts = [(1, f"x {long} y"), (2, "one two three four five six"), (3, "aone two three four five six sevenb"), (4, "a redred fox"), (5, None), (6, ""), (7, "one  two three four five six seven"), (1, "again"), (8, "one two three four five six eight"), (None, short)]
    df = spark.createDataFrame(texts, "id long, text string")
    held = spark.createDataFrame([(long,), (short,), (None,), (long,), ("one two three four five six eighty",), ("foxes",)], "text string")
    assert {r.id for r in passages.contained(df, held).collect()} == {1, 3, 4, None}
    assert passages.contained(df, held).count() == 4
    assert passages.contained(df.limit(0), held).count() == 0 and passages.contained(df, held.limit(0)).count() == 0
    everything = spark.createDataFrame([("",)], "text string")
    assert passages.contained(df, everything).count() == len({i for i, t in texts if t is not None})


@pytest.mark.parametrize("most", [1000, 0])
def test_overlaps(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "MOST_RUNS", most)
    rnd = random.Random(2)
    some = [" ".join(rnd.choice(["a", "Bb", "c1", "d-d"]) for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    rows = [*enumerate(some), (3, some[5]), (70, None), (71, ""), (None, some[1])]
    held = [*enumerate(some[:20], 100), (100, some[30]), (130, None)]

    def runs(t, n=3):
        words = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    want = {}
    for keyed, into in ((rows, 0), (held, 1)):
        for i, t in keyed:
            want.setdefault((into, i), set()).update(runs(t))
    pairs = {(a[1], b[1]): len(want[a] & want[b]) for a in want if not a[0] for b in want if b[0]}
    got = passages.overlaps(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(held, "item long, text string"), 3).collect()
    assert {(r.id, r.item): r.n for r in got} == {k: n for k, n in pairs.items() if n} and len(got) > 50


def test_interval_pairs(spark):
    rows = [(i, "u" if i % 2 else None, t) for i, t in enumerate((0, 5, 9, 15, 16, 30))]
    df = spark.createDataFrame(rows, "id long, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("t"))
    got = {(r.a, r.z) for r in joins.interval_pairs(df, df, "k", "t", 10).collect()}
    assert got == {(i, j) for i, k, s in rows for j, m, t in rows if k and k == m and 0 <= t - s <= 10}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x long, by string")
    for kind in ("parquet", "json"):
        tables.write_partitioned(df, f"file://{tmp_path}/{kind}", "by", kind)
        back = spark.read.format(kind).schema("x long, by string").load(f"file://{tmp_path}/{kind}")
        assert sorted((r.x, r.by) for r in back.collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert tables.whole_files(spark, f"file://{tmp_path}/json").where("length > 0").count() >= 3


def test_tables_are_found_by_name(spark):
    assert tables.sql(spark, "/root/testdata/sf0.001", "SELECT count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey").first().n == 25
