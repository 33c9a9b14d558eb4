"""Operator 2: packed token ids by best-fit decreasing, as binary matrices.

Documents are split without loss into pieces of at most SIZE ids. Pieces of a run, longest first, go to
the open sequence with the least room that still fits, found in a segment tree over the SIZE + 1 possible
capacities (a node tells whether a sequence of such capacity is open). Full sequences leave at the
end of a run; the pieces of sequences that are less than FULL full are packed again with the next run,
so only a partition's last run leaves room. No shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, tokens
from tessera.llm.tokens import WordIds

SIZE, RUN, FULL, PAD = 2048, 600_000, 0.98, 0


class Capacities:
    """A segment tree over capacities 0 to size, which finds the least open one that is large enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += n
            i >>= 1

    def least(self, need: int) -> int | None:
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Indexes of the pieces of each sequence."""
    tree, of, bins = Capacities(size), [[] for _ in range(size + 1)], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        room = tree.least(n)
        if room is None:
            b, room = len(bins), size
            bins.append([])
        else:
            b = of[room].pop()
            tree.add(room, -1)
        bins[b].append(k)
        if room > n:
            of[room - n].append(b)
            tree.add(room - n, 1)
    return bins


_SEQUENCES = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary, ids_crc32 long"


def id_type(vocab: dict[str, int]) -> str:
    """Two bytes an id, or four where the vocabulary has ids that two do not hold."""
    return "<u2" if max(vocab.values()) < 1 << 16 else "<u4"


def _packer(path: str):
    def emit(bins: list, number: int, kind: str) -> pa.RecordBatch:
        rows: dict = {k: [] for k in ("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids", "ids_crc32")}
        for k, pieces in enumerate(bins):
            ids, lens = np.concatenate([p[2] for p in pieces]), [len(p[2]) for p in pieces]
            ends = np.cumsum([0, *lens])
            matrix, places = np.full(SIZE, PAD, kind), np.zeros(SIZE, "<u2")
            matrix[: len(ids)] = ids
            places[: len(ids)] = np.arange(len(ids)) - np.repeat(ends[:-1], lens)
            for key, v in zip(rows, (number + k, len(ids), [p[0] for p in pieces], [p[1] for p in pieces], ends.tolist(), matrix.tobytes(), places.tobytes(), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                rows[key].append(v)
        schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("ids_crc32", pa.int64())])
        return pa.RecordBatch.from_pydict(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number, items, held = WordIds(path), TaskContext.get().partitionId() << 36, [], 0
        kind = id_type(words.vocab())

        def packed(last: bool) -> tuple[list, list]:
            bins = [[items[k] for k in b] for b in best_fit_decreasing([len(x[2]) for x in items])]
            full = [b for b in bins if last or sum(len(x[2]) for x in b) >= FULL * SIZE]
            return full, [] if last else [x for b in bins if sum(len(x[2]) for x in b) < FULL * SIZE for x in b]

        for doc, ids in words.documents(batches):
            items += [(doc, at, ids[at : at + SIZE]) for at in range(0, len(ids), SIZE)]
            held += len(ids)
            if held >= RUN:
                full, items = packed(False)
                held = sum(len(x[2]) for x in items)
                for at in range(0, len(full), 128):
                    yield emit(full[at : at + 128], number + at, kind)
                number += len(full)
        full = packed(True)[0]
        for at in range(0, len(full), 128):
            yield emit(full[at : at + 128], number + at, kind)

    return run


def packed_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each sequence of docs (doc_id, text): its pieces (doc_ids, starts), cumulative lengths, and rows of
    two matrices, ids and positions that start again at 0 with every piece, as little-endian uint16 padded to SIZE (ids as uint32
    where the vocabulary needs it: input_ids then has four bytes an id). What lies beyond n_tokens is padding, whatever its id.

    Null, empty and blank texts are their end id alone; rows without doc_id have null among doc_ids. Repeated rows are packed each. Pieces of equal
    length go in the order of their rows. No docs, no sequences. Other columns of docs are not looked at.
    """
    common.small_batches(docs.sparkSession, 256)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(common.gives_back(_packer(path or tokens.default_path())), _SEQUENCES)


def write_packed(docs: DataFrame, where: str, path: str | None = None) -> None:
    """The matrices as Parquet files, one row a sequence."""
    packed_ids(docs, path).write.mode("overwrite").parquet(where)


def op2_pack_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids(common.table(spark, sf_dir, "documents"))
