"""Joins by order: as-of over two tables, and pairs by two inequalities or their counts, over ranges of sorted rows, without a nested loop.

Ranges are cut by Spark's range partitioning over all columns of the order, so a key or a value that a third of all rows share is many ranges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table

#: Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of either side of a block of pairs.
BLOCK = 16_384
#: Rows of either side of a strip, on the average, and the most strips of a column.
STRIP, STRIPS = 200_000, 512
_SIDED = "key long, at long, side int, id long, spread long"


def asof(left: DataFrame, right: DataFrame, tolerance: int | None = None) -> DataFrame:
    """id, match and behind: for each row of left (id, key, at) the latest row of right (id, key, at) of its key that is not later, its id, and how
    long before it was; of right rows at one time the one with the largest id. at is a whole number, say of microseconds; matches further back than tolerance are none.

    Both sides are sorted together over ranges of (key, at), and the last right row is carried along a range by a running maximum. What a range begins with is taken
    from the ranges before: of each, its first and last key and last right row go to the driver, one row a range. So a key with a third of all rows is as many tasks as
    it has ranges. Left rows with a null key or time match nothing; right rows with one are no match. Repeated ids are rows of their own.
    """
    spark, scratch = left.sparkSession, Scratch(left.sparkSession, "asof")
    sided = lambda df, side: df.select(F.col("key").cast("long").alias("key"), F.col("at").cast("long").alias("at"), F.lit(side).alias("side"), F.col("id").cast("long").alias("id"))
    right = right.where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL")
    both = sided(right, 0).union(sided(left, 1)).withColumn("spread", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "at", "side", "id", "spread"]
    rows = scratch.write(both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33)
    last = F.max(F.when(F.col("side") == 0, F.struct("place", "key", "at", "id")))
    ends = rows.groupBy(part.alias("part")).agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"), last.alias("right")).collect()  # a row a range
    carried, now = {}, None
    for r in sorted(ends, key=lambda r: r.part):
        if now and now[0] == r.first:
            carried[r.part] = now
        if r.right and r.right.key == r.last:
            now = (r.right.key, r.right.at, r.right.id)
        elif not (now and now[0] == r.last):
            now = None
    known = spark.sparkContext.broadcast(carried)
    sorted_ = rows.repartitionById(max([r.part for r in ends], default=0) + 1, part.cast("int")).sortWithinPartitions("place")
    return sorted_.select(part.alias("part"), "key", "at", "side", "id").mapInArrow(_follower(known, tolerance), "id long, match long, behind long")


def _follower(broadcast, tolerance: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried = None, broadcast.value
        for batch in batches:
            if not batch.num_rows:
                continue
            part, key, at, side, id_ = (np.ma.masked_array(c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)) for c in batch.columns)
            held = held or carried.get(int(part[0])) or (None, 0, 0)
            # the row before the batch is the last right row that is known; -1 where none is
            index = np.where((side == 0) & ~key.mask, np.arange(len(batch)), -1)
            index = np.maximum.accumulate(index)
            there, where = index >= 0, np.maximum(index, 0)
            known_key = np.where(there, key.data[where], held[0] if held[0] is not None else 0)
            ok = np.where(there, True, held[0] is not None) & ~key.mask & ~at.mask & (known_key == key.data)
            back = at.data - np.where(there, at.data[where], held[1])
            match = np.where(there, id_.data[where], held[2])
            if tolerance is not None:
                ok &= back <= tolerance
            left = side == 1
            none = pa.array(~ok[left])
            yield pa.RecordBatch.from_arrays([batch.column(4).filter(pa.array(np.asarray(left))), *[pa.array(np.asarray(x)[left], pa.int64(), mask=np.asarray(none)) for x in (match, back)]], ["id", "match", "behind"])
            if there[-1]:
                held = (int(key.data[index[-1]]), int(at.data[index[-1]]), int(id_.data[index[-1]]))

    return run


def inequality_pairs(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """a and b: the ids of all pairs of a row of left and one of right (id, x, y) with left x < right x and left y > right y.

    Each side is sorted by (x, y) and cut into ranges of about block rows. The least and greatest x and y of each range (four numbers a range, on the driver) say
    which ranges of the two sides can hold a pair; ranges meet as blocks, in which rows of the left are taken by rising y while bits are set
    for the right rows with a smaller y, at their places by x, so the partners of a row are the bits behind its x. A block never holds more than two ranges and the
    pairs of one row. Rows with a null in x or y are in no pair; repeated ids are rows of their own. Where most rows pair with most rows, the result itself is quadratic.
    """
    scratch = Scratch(left.sparkSession, "inequality")
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        rows = df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        n = max(1, -(-rows.count() // block))
        rows = rows.withColumn("spread", F.monotonically_increasing_id())
        rows = scratch.write(rows.repartitionByRange(n, "x", "y", "spread").drop("spread").withColumn("range", F.spark_partition_id()), name)
        bounds = rows.groupBy("range").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()
        sides.append((rows, bounds))
    (left, lb), (right, rb) = sides
    meets = [(p.range, q.range) for p in lb for q in rb if p.x0 < q.x1 and p.y1 > q.y0]
    blocks = left.sparkSession.createDataFrame(meets, "l int, r int")
    rows = left.join(blocks, left["range"] == blocks["l"]).select("l", "r", F.lit(0).alias("side"), "id", "x", "y")
    told = right.join(blocks, right["range"] == blocks["r"]).select("l", "r", F.lit(1).alias("side"), "id", "x", "y")
    return rows.union(told).groupBy("l", "r").applyInArrow(_pairs, "a long, b long")


def _pairs(block: pa.Table) -> pa.Table:
    side, id_, x, y = (block[c].to_numpy() for c in ("side", "id", "x", "y"))
    asks, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    asks, r = asks[np.argsort(y[asks], kind="stable")], r[np.argsort(x[r], kind="stable")]
    by_y = np.argsort(y[r], kind="stable")
    below = np.searchsorted(y[r][by_y], y[asks], "left")  # right rows with a smaller y
    behind = np.searchsorted(x[r], x[asks], "right")  # places with a larger x begin here
    bits, set_, a, b = np.zeros(len(r), bool), 0, [], []
    for i, upto, first in zip(asks, below, behind, strict=True):
        bits[by_y[set_:upto]] = True
        set_ = upto
        found = np.flatnonzero(bits[first:])
        if len(found):
            a.append(np.full(len(found), id_[i]))
            b.append(id_[r[found + first]])
    flat = lambda v: np.concatenate(v) if v else np.empty(0, np.int64)
    return pa.table({"a": pa.array(flat(a), pa.int64()), "b": pa.array(flat(b), pa.int64())})


def inequality_counts(left: DataFrame, right: DataFrame, strip: int = STRIP) -> DataFrame:
    """id, n and last: of each id of left that has partners in inequality_pairs, how many pairs it has and the greatest id among its partners, without making the pairs.

    x and y are cut at bounds into strips, by turns an open range and a bound by itself, so a value that very many rows share is a strip in which nothing is less than
    another. A partner lies in the same strip of x, or further on in the same strip of y, or further on in both. The first two are counted in the strips, one
    task each, by halving; the last by running sums over the grid of strips, which is broadcast: (2 * STRIPS + 1)^2 cells at most. So each row is shuffled twice, however many pairs
    there are. A strip has about `strip` rows of a side up to STRIPS strips. Rows with a null in x or y are in no pair; pairs of repeated ids are summed.
    """
    spark, scratch = left.sparkSession, Scratch(left.sparkSession, "inequality")
    sided = lambda df, side: df.select(F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    both = sided(left, 0).union(sided(right, 1))
    n = min(STRIPS, max(1, -(-both.count() // (2 * strip))))
    cuts = both.agg(*[F.percentile_approx(c, [k / n for k in range(1, n)] or [0.5], 10_000).alias(c) for c in "xy"]).first()
    cuts = [np.unique(np.array(c or [0.0])) for c in cuts]
    rows = scratch.write(both.mapInArrow(_stripper(cuts), "side int, id long, x double, y double, xs int, ys int"), "rows")
    cells = rows.where("side = 1").groupBy("xs", "ys").agg(F.count("*").alias("n"), F.max("id").alias("last")).toArrow()
    grid = spark.sparkContext.broadcast(_grid(cells, *[2 * len(c) + 1 for c in cuts]))
    beyond = rows.where("side = 0").select("id", "xs", "ys").mapInArrow(_beyond(grid), _COUNTED)
    asks = rows.select("side", "id", "x", "y", "xs", "ys")
    within = asks.where("xs % 2 = 0").select(F.lit(0).alias("kind"), F.col("xs").alias("strip"), "side", "id", F.col("x").alias("u"), "y")
    along = asks.where("ys % 2 = 0").select(F.lit(1).alias("kind"), F.col("ys").alias("strip"), "side", "id", F.col("xs").cast("double").alias("u"), "y")
    inside = within.union(along).groupBy("kind", "strip").applyInArrow(_dominated, _COUNTED)
    return beyond.union(inside).groupBy("id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _stripper(cuts: list[np.ndarray]):
    """Rows with the strips of their x and y: twice the bounds below, and one more at a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strips = [np.searchsorted(c, batch.column(k).to_numpy(zero_copy_only=False), "left") + np.searchsorted(c, batch.column(k).to_numpy(zero_copy_only=False), "right") for k, c in zip((2, 3), cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(s, pa.int32()) for s in strips]], ["side", "id", "x", "y", "xs", "ys"])

    return run


#: Less than every id.
_NONE = np.iinfo(np.int64).min


def _grid(cells: pa.Table, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the rows, and their greatest id, of the cells with a greater strip of x and a smaller strip of y."""
    n, last = np.zeros((w + 1, h + 1), np.int64), np.full((w + 1, h + 1), _NONE)
    at = cells["xs"].to_numpy(), cells["ys"].to_numpy() + 1
    n[at], last[at] = cells["n"].to_numpy(), cells["last"].to_numpy()
    n = np.cumsum(np.cumsum(n[::-1], 0)[::-1], 1)
    last = np.maximum.accumulate(np.maximum.accumulate(last[::-1], 0)[::-1], 1)
    return n[1:], last[1:]


_COUNTED = "id long, n long, last long"


def _counted(id_: np.ndarray, n: np.ndarray, last: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    some = n > 0
    return [pa.array(x[some], pa.int64()) for x in (id_, n, last)], ["id", "n", "last"]


def _beyond(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = broadcast.value
        for batch in batches:
            id_, xs, ys = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays(*_counted(id_, n[xs, ys], last[xs, ys]))

    return run


def _dominated(strip: pa.Table) -> pa.Table:
    """_COUNTED of the left rows of a strip, over its right rows with a greater u and a smaller y.

    Rows are placed by falling u and taken by rising y. At each halving of the places, a left row of a later half meets the right rows of the earlier half that were
    taken before it: running sums and maxima over all halves at once. At equal values left rows come first.
    """
    side, id_, u, y = (strip[c].to_numpy() for c in ("side", "id", "u", "y"))
    if not side.any() or side.all():
        return pa.table(*_counted(*[np.empty(0, np.int64)] * 3))
    place = np.lexsort((side, -u))
    side, id_, y = side[place], id_[place], y[place]
    ids, rank = np.unique(id_, return_inverse=True)
    n, last = np.zeros(len(side), np.int64), np.zeros(len(side), np.int64)
    taken = np.lexsort((side, y))  # in blocks of places, the greatest first; by y in each
    for k in range(int(len(side) - 1).bit_length() - 1, -1, -1):
        block, later = taken >> (k + 1), (taken >> k & 1).astype(bool)
        first = block << (k + 1)
        told = ~later & (side[taken] == 1)
        sums = np.concatenate([[0], np.cumsum(told)])
        most = np.maximum.accumulate(np.where(told, rank[taken] + 1, 0) + block * (len(ids) + 1)) - block * (len(ids) + 1)
        asks = np.flatnonzero(later & (side[taken] == 0))
        at = taken[asks]
        n[at] += sums[asks + 1] - sums[first[asks]]
        last[at] = np.maximum(last[at], most[asks])
        ends = np.cumsum(~later) - (block << k)  # rows of the earlier half so far; blocks before are full
        halved = np.empty_like(taken)
        at = np.arange(len(taken))
        halved[np.where(later, first + (1 << k) + at - first - ends, first + ends - 1)] = taken
        taken = halved
    return pa.table(*_counted(id_, n, ids[np.maximum(last, 1) - 1]))


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the customer's latest order of the ninety days before, orders being moved to the events' years by 8400 days."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), micros("ts").alias("at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), (micros("o_orderdate") + 8400 * 86_400_000_000).alias("at"))
    return asof(events, orders, 90 * 86_400_000_000).select(F.col("id").alias("event_id"), F.col("match").alias("o_orderkey"), (F.col("behind") / 1_000_000).cast("long").alias("seconds"))


def cheaper_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of which the second is later and costs less than a two-hundredth of the first: how many of each first one, and its last one by key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("x"), F.col("o_totalprice").alias("y"))
    return inequality_counts(o, o.withColumn("y", 200 * F.col("y"))).select(F.col("id").alias("o_orderkey"), "n", "last")


QUERIES = {"asof_two_tables": asof_orders, "join_inequality": cheaper_later}
SQL = {
    "asof_two_tables": "SELECT e.event_id, CASE WHEN ok THEN o.o_orderkey END AS o_orderkey, CASE WHEN ok THEN s END AS seconds FROM (SELECT e.event_id, o.o_orderkey, (epoch_us(e.ts) - epoch_us(o.at)) // 1000000 AS s, coalesce(epoch_us(e.ts) - epoch_us(o.at) <= 90 * 86400000000, false) AS ok, row_number() OVER (PARTITION BY e.event_id ORDER BY o.at DESC, o.o_orderkey DESC) AS rn FROM events e LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 8400 DAY AS at FROM orders) o ON o.o_custkey = e.user_id AND o.at <= e.ts) o JOIN events e ON e.event_id = o.event_id WHERE rn = 1",
    "join_inequality": "SELECT a.o_orderkey, count(*) AS n, max(b.o_orderkey) AS last FROM orders a JOIN orders b ON a.o_orderdate < b.o_orderdate AND a.o_totalprice > 200 * b.o_totalprice GROUP BY 1",
}
