"""Helpers of the training-data operators: batches, row keys, joins with hot keys, sorted runs, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera.llm
from tessera.sources.shared import Scratch
from tessera.sources.tables import table

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "SPACE", "Scratch", "bounded", "components", "gives_back", "hot_join", "keyed", "renamed", "runs", "small_batches", "table", "without"]

#: Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(tessera.llm)

#: ASCII white space, as the contracts have it: x20 and x09 to x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Most rows that are ever broadcast; beyond it, the same join is shuffled.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch; a batch of documents stays far below a worker's memory.
BATCH_ROWS = 512
#: Rows of one key that stay together in a join; a key with more is dealt over several tasks.
HOT_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, so that long texts do not add up to more than a worker can hold. The setting stays lowered, as results
    are computed later; no operator's result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def gives_back(run):
    """run, a function of batches, that returns free memory to the system when it ends: the worker lives on and serves other operators, whose
    tasks need room, too."""

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
        if trim:
            trim(0)

    return all_


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows stay below BROADCAST_ROWS; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _is_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in str(plan.relation()).lower()


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with __f (a hash of the row's file) and __i (its place there), which name a row of a written table, whatever its columns hold.

    docs that are not a scan of Parquet files are written first, since only written rows have a place.
    """
    if not _is_scan(docs):
        docs = scratch.write(docs, "keyed")
    where = docs.metadataColumn("_metadata")
    return docs.withColumns({"__f": F.xxhash64(where["file_path"]), "__i": where["row_index"]})


def renamed(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with columns other than keep under names of our own, so that none can clash, and the columns that give the old ones back."""
    names = {c: c if c in keep else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def without(rows: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (with __f, __i) but those named in gone (__f, __i); the keys are left out."""
    gone = scratch.write(gone.select("__f", "__i"), "gone")
    return rows.join(bounded(gone, gone.count()), ["__f", "__i"], "left_anti").drop("__f", "__i")


def hot_join(many: DataFrame, one: DataFrame, on: list[str], sizes: DataFrame, rows: int, salt: Column, how: str = "inner") -> DataFrame:
    """many joined to one (unique by on). sizes has on and n, the number of rows of many; keys with more than HOT_ROWS rows are
    dealt over several tasks by salt, and their row of one is sent to each. Such keys are at most 100,000, as they share rows rows."""
    most = max(HOT_ROWS, rows // 100_000)
    hot = F.broadcast(sizes.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("__parts")))
    left = many.join(hot, on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = one.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, of a partition sorted by them, and where the runs start. A table has about so
    many rows, and more only where a run has."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(last: bool) -> tuple[pa.Table, np.ndarray, list]:
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            x = t[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        end = len(t) if last else int(starts[-1])
        return t.slice(0, end), starts[starts < end], [] if last else t.slice(end).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            some, starts, held = cut(False)
            n = sum(len(x) for x in held)
            if n >= rows:  # one long run: look again when twice as many rows have come
                rows = 2 * n
            if len(some):
                yield some, starts
    if held:
        some, starts, _ = cut(True)
        yield some, starts


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) of every node in edges (a, b): alternating large-star and small-star rounds.

    root is the least node that can be reached. Rounds end when the edges no longer change; each
    round is a written table. Minima are pre-aggregated; a hub's edges are dealt over several tasks.
    """

    def digest(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(h % 1_000_003), F.sum(h % 998_244_353)).first())

    def star(edges: DataFrame, low: DataFrame, rows: int) -> DataFrame:
        return hot_join(edges, low.select("a", "m"), ["a"], low.select("a", "n"), rows, F.col("b"))

    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, k = digest(now), 0
    while seen[0]:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = star(both, low, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.write(large, f"{name}-large-{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # of a node: at most its neighbours after the large star, which are roots so far
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m")).distinct()
        k += 1
        now = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-large-{k - 1}")
        last, seen = seen, digest(now)
        if seen == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
