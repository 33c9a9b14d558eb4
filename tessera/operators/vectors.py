"""Nearest vectors by cosine: exactly, in blocks, and by an index of inverted lists with exact re-ranking.

Both ways compare blocks of asking rows with blocks of told rows inside tasks, by one matrix product, and only the best k of each query leave a task.
The index puts every vector into the cell of its nearest centre, with a code of a byte a dimension. A query looks at the cells whose centres
are nearest to it; tasks get codes only and give the best few rows by them, and these are compared by their vectors. Centres are fitted on a
bounded sample; cells are split into parts of bounded size, so a cell that many vectors share is many tasks.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch
from tessera.sources.tables import table

#: Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block of vectors.
BLOCK = 2048
#: Vectors that centres are fitted on at most, centres at most, and rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 12
#: The share of cells that a query looks at, and how many rows are compared exactly for each that is wanted. So many cells are for vectors without any
#: clusters, as those of the given tables; of clustered ones a few cells hold the neighbours.
PROBED, RANKED = 0.85, 4
#: Similarities that differ by less are ties, which ids decide.
_DIGITS = 12


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """id, rank, near, similarity: the k rows of vectors (id, v) with the largest cosine to each of queries, itself left out; ties by id.

    Both sides are dealt to blocks of about `block` rows; a task multiplies one block of queries with one of vectors and gives the best k of
    each query, so it holds two blocks and no pair leaves it but those. Null and zero vectors are near to nothing.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    n, m = parts(vectors), parts(queries)
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    right = vectors.select(F.lit(False).alias("asks"), F.col("id"), "v", deal(n).alias("ri"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qi"))
    left = queries.select(F.lit(True).alias("asks"), F.col("id"), "v", deal(m).alias("qi"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ri"))
    both = left.select("asks", "id", "v", "qi", "ri").unionByName(right.select("asks", "id", "v", "qi", "ri")).where("v IS NOT NULL")
    return _ranked(both.groupBy("qi", "ri").applyInArrow(_best(k), _FOUND), k)


_FOUND = "id long, near long, similarity double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc(F.round("similarity", _DIGITS)), "near")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their lengths, and which of them have one."""
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    good = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
    return v / np.where(good[:, None], norm, 1), good


def _best(k: int):
    """The k nearest told rows of each asking row of a block (asks, id, v)."""

    def run(block: pa.Table) -> pa.Table:
        found = []
        if len(block):
            asks, ids = block["asks"].to_numpy(), block["id"].to_numpy()
            v, good = unit(np.stack(block["v"].to_numpy()).astype(float))
            q, r = np.flatnonzero(asks & good), np.flatnonzero(~asks & good)
            if len(q) and len(r):
                s = np.round(v[q] @ v[r].T, _DIGITS)
                s[ids[q][:, None] == ids[r][None, :]] = -np.inf
                for row, own in zip(s, ids[q], strict=True):
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero((row >= least) & (row > -np.inf))
                    near = near[np.lexsort((ids[r][near], -row[near]))][:k]
                    found += [(own, ids[r][j], row[j]) for j in near]
        return pa.table({name: pa.array([x[c] for x in found], t) for c, (name, t) in enumerate((("id", pa.int64()), ("near", pa.int64()), ("similarity", pa.float64())))})

    return run


def fit_centres(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centres of cells, fitted on SAMPLE vectors with the least hashes of their ids, or all if there are fewer; by default the root of the vectors' number, MOST_CELLS at most.

    No vectors give no centres. The same vectors give the same centres.
    """
    n = vectors.count()
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS)
    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    some = vectors.where(F.col("v").isNotNull() & (h <= min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 40))).orderBy(h, "id").limit(SAMPLE)
    rows = some.select("v").toArrow()["v"].to_numpy()  # at most SAMPLE
    if not len(rows):
        return np.empty((0, 1))
    v, good = unit(np.stack(rows).astype(float))
    v = np.unique(v[good], axis=0)
    if not len(v):
        return np.empty((0, 1))
    at = np.random.default_rng(7)
    c = v[[at.integers(len(v))]]
    while len(c) < min(cells, len(v)):  # next centres: far ones are likelier
        far = np.maximum(1 - (v @ c.T).max(1), 0)
        if far.sum() <= 1e-9:
            break
        c = np.vstack([c, v[at.choice(len(v), size=min(max(1, len(c) // 2), min(cells, len(v)) - len(c)), replace=False if (far > 0).sum() >= max(1, len(c) // 2) else True, p=far / far.sum())]])
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        moved, good = unit(sums)
        c = np.where(good[:, None], moved, c)
    return c


def _coded(v: np.ndarray) -> np.ndarray:
    """Rows of length one as bytes."""
    most = np.abs(v).max(1, keepdims=True)
    return np.round(127 * v / np.where(most > 0, most, 1)).astype(np.int8)


def _placer(broadcast, most: int):
    """Rows (id, v) whose vector has a length, with their code and the numbers of the most nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = broadcast.value
        for batch in batches:
            v, good = unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)) if len(batch) else (np.empty((0, 1)), np.empty(0, bool))
            at = np.flatnonzero(good) if len(c) else np.empty(0, int)
            if not len(at):
                continue
            near = np.argsort(-(v[at] @ c.T), axis=1, kind="stable")[:, :most]
            rows, codes = np.repeat(at, near.shape[1]), [x.tobytes() for x in _coded(v[at])]
            codes = pa.array(codes, pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), codes, pa.array(near.reshape(-1).astype(np.int32))], ["id", "v", "code", "cell"])

    return run


def _in_cells(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(centres)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
    return rows.mapInArrow(_placer(known, most), "id long, v array<double>, code binary, cell int")


def _best_codes(k: int):
    """The k told rows (row, id, code) of a block whose codes are nearest to each asking row's (id, code)."""

    def run(block: pa.Table) -> pa.Table:
        found = []
        if len(block):
            asks, ids, rows = block["asks"].to_numpy(), block["id"].to_numpy(), block["row"].to_numpy()
            v, _ = unit(np.stack([np.frombuffer(x.as_buffer(), np.int8) for x in block["code"]]).astype(np.float32))
            q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
            if len(q) and len(r):
                s = v[q] @ v[r].T
                s[ids[q][:, None] == ids[r][None, :]] = -np.inf
                for row, own in zip(s, ids[q], strict=True):
                    near = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    found += [(own, int(rows[r[j]]), float(row[j])) for j in near if row[j] > -np.inf]
        return pa.table({name: pa.array([x[c] for x in found], t) for c, (name, t) in enumerate((("id", pa.int64()), ("row", pa.int64()), ("about", pa.float64())))})

    return run


class VectorIndex:
    """Every row of vectors (id, v) in the cell of its nearest centre, as a written table. Null and zero vectors are in none, as they are near to nothing."""

    def __init__(self, vectors: DataFrame, cells: int | None = None):
        self.scratch = Scratch(vectors.sparkSession, "vectors")
        self.centres = fit_centres(vectors, cells)
        self.rows = self.scratch.write(_in_cells(vectors, self.centres, 1).withColumn("row", F.monotonically_increasing_id()), "cells")
        self.sizes = self.scratch.write(self.rows.groupBy("cell").agg(F.count("*").alias("n")), "sizes")  # a row a cell

    def search(self, queries: DataFrame, k: int, probes: int | None = None, block: int = BLOCK) -> DataFrame:
        """As nearest_vectors, among the rows of the probes cells nearest to each query (by default PROBED of all) whose codes are nearest. Fewer than k rows are
        given where these cells hold fewer. The ids of queries are different."""
        probes = probes or max(1, int(PROBED * len(self.centres)))
        parts = F.ceil(F.col("n") / block).cast("int")
        told = self.rows.select("id", "row", "code", "cell").join(F.broadcast(self.sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("n")
        asked = self.scratch.write(_in_cells(queries, self.centres, probes).join(F.broadcast(self.sizes), "cell"), f"asked-{uuid.uuid4().hex}")
        # a cell that very many queries ask is dealt over them, too, and its rows go to each share
        asks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("shares"))
        parted = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).join(F.broadcast(asks), "cell").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        told = told.join(F.broadcast(asks), "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        columns = ["id", "row", "code", "cell", "part", "share", "asks"]
        both = parted.withColumns({"row": F.lit(None).cast("long"), "asks": F.lit(True)}).select(*columns).union(told.withColumn("asks", F.lit(False)).select(*columns))
        some = both.groupBy("cell", "part", "share").applyInArrow(_best_codes(RANKED * k), "id long, row long, about double")
        some = some.withColumn("at", F.row_number().over(W.partitionBy("id").orderBy(F.desc("about"), "row"))).where(F.col("at") <= RANKED * k)
        q = asked.groupBy("id").agg(F.any_value("v").alias("asking"))
        pairs = some.join(q, "id").join(self.rows.select("row", F.col("id").alias("near"), "v"), "row")
        return _ranked(pairs.select("id", "near", cosine("asking", "v").alias("similarity")), k)


def cosine(a: str, b: str) -> Column:
    """Of two columns of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every vector whose id is divisible by 100, among all."""
    e = _vectors(spark, sf_dir)
    return nearest_vectors(e, e.where("id % 100 = 0"), 3).select(F.col("id").alias("vec_id"), "rank", "near", F.round("similarity", 6).alias("similarity"))


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against exact search, for the ten nearest of every vector whose id is divisible by 100: queries, vectors indexed, whether 90 percent of the
    neighbours are found, with their exact similarity, and whether fewer than a fifth of the pairs were compared by their vectors."""
    e = _vectors(spark, sf_dir)
    queries, n = e.where("id % 100 = 0"), e.count()
    index = VectorIndex(e)
    found = index.search(queries, 10).select("id", "near", F.round("similarity", 9).alias("similarity"))
    exact = nearest_vectors(e, queries, 10).select("id", "near", F.round("similarity", 9).alias("similarity"))
    told = exact.join(found.withColumn("found", F.lit(1)), ["id", "near", "similarity"], "left")
    return told.agg(F.count_distinct("id").alias("queries"), F.lit(index.rows.count()).alias("indexed"), (F.count("found") >= 0.9 * F.count("*")).alias("recalled"), F.lit(5 * RANKED * 10 < n).alias("few"))


QUERIES = {"cosine_top_k": cosine_top_k, "vector_index": index_recall}
SQL = {
    "vector_index": "SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, count(*) FILTER (list_sum(list_transform(embedding, lambda x: x * x)) > 0) AS indexed, true AS recalled, true AS few FROM embeddings",
    "cosine_top_k": """
SELECT vec_id, rank, near, similarity FROM (
  SELECT q.vec_id, r.vec_id AS near, s, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, r.vec_id) AS INT) AS rank
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) r ON q.vec_id <> r.vec_id,
  LATERAL (SELECT list_cosine_similarity(q.v, r.v) AS s))
WHERE rank <= 3""",
}
