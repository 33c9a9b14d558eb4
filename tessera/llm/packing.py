"""Operator 6: order-preserving packing by dynamic programming over window cuts.

Documents of a partition, in their order, form a line of tokens. A cut may fall after a document
(free), after a sentence, or, where a sentence is long, every GAP tokens (dearer each). Window (i, j] costs
its padding, size - (c_j - c_i), plus the penalty of its cut at j:

    f(j) = size - c_j + penalty(j) + min over i with c_j - c_i <= size of (f(i) + c_i)

The minimum over the sliding window of i comes from a monotone queue, so a cut costs constant time.
The line is treated in runs of RUN tokens; the last window of a run is carried into the next run,
so only the last window of a partition is cut short. No shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, tokens
from tessera.llm.tokens import WordIds, sentence_ends

SIZE, GAP, RUN = 2048, 48, 600_000
#: What a cut after a document, after a sentence and inside one costs, in tokens of padding.
AFTER_DOC, AFTER_SENTENCE, INSIDE = 0, 2, 6


def candidates(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cuts, from 0 on, and their penalties; ends and sentences: positions after documents and sentences."""
    at = np.union1d(np.union1d(ends, sentences), [0])
    gaps = np.diff(at)
    more = np.maximum(0, (gaps - 1) // GAP)
    inside = np.repeat(at[:-1], more) + GAP * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    c = np.union1d(at, inside)
    pen = np.full(len(c), INSIDE)
    pen[np.searchsorted(c, sentences)] = AFTER_SENTENCE
    pen[np.searchsorted(c, ends)] = AFTER_DOC
    return c, pen


def best_cuts(c: np.ndarray, pen: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The positions of the cheapest cuts, first 0 and last c[-1]."""
    at, cost = c.tolist(), pen.tolist()
    f, came, queue, head = [0] * len(at), [0] * len(at), [0], 0
    g = [0] * len(at)
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[head]] < x - size:
            head += 1
        i = queue[head]
        came[j] = i
        f[j] = g[i] + size - x + cost[j]
        v = g[j] = f[j] + x
        while len(queue) > head and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j, cuts = len(at) - 1, [at[-1]]
    while j:
        j = came[j]
        cuts.append(at[j])
    return np.array(cuts[::-1])


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def _pack(items: list, ends_sentence: np.ndarray, first_id: int, last: bool) -> tuple[dict | None, list, int]:
    """items: (doc_id, start, ids, doc_tokens). Rows of the pieces, the items carried on, the next sequence's number."""
    ids = np.concatenate([x[2] for x in items])
    ends = np.cumsum([len(x[2]) for x in items])
    c, pen = candidates(ends, np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1)
    cuts = best_cuts(c, pen)
    if not last and len(cuts) > 2:
        cuts = cuts[:-1]
    elif not last:
        return None, items, first_id
    done = int(cuts[-1])
    starts = np.unique(np.concatenate([cuts[:-1], ends[ends < done], [0]]))
    stops = np.append(starts[1:], done)
    doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right") - 1
    begins = ends - np.array([len(x[2]) for x in items])
    base, total = np.array([x[1] for x in items]), np.array([x[3] for x in items])
    names = np.array([x[0] for x in items], object)
    raw = memoryview(ids.astype("<u4").tobytes())
    lens = np.diff(cuts)
    padded = np.where(lens & (lens - 1) == 0, lens, SIZE)
    rows = {"doc_id": pa.array(names[doc].tolist(), pa.int64()), "start": starts - begins[doc] + base[doc], "length": stops - starts, "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64), "doc_tokens": total[doc], "sequence_id": seq + first_id, "offset": starts - cuts[seq], "padded_length": padded[seq]}
    k = int(np.searchsorted(ends, done, "right"))
    rest = items[k:]
    if rest and (skip := done - int(begins[k])) > 0:
        rest[0] = (items[k][0], items[k][1] + skip, items[k][2][skip:], items[k][3])
    return rows, rest, first_id + len(lens)


def _packer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = WordIds(path)
        ends_sentence = sentence_ends(words.vocab())
        items, held, number = [], 0, TaskContext.get().partitionId() << 36
        for doc, ids in words.documents(batches):
            items.append((doc, 0, ids, len(ids)))
            held += len(ids)
            if held >= RUN:
                rows, items, number = _pack(items, ends_sentence, number, False)
                held = sum(len(x[2]) for x in items)
                if rows:
                    yield pa.RecordBatch.from_pydict(rows)
        if items:
            yield pa.RecordBatch.from_pydict(_pack(items, ends_sentence, number, True)[0])

    return run


def pack_in_order(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each piece of docs (doc_id, text), as the contract has it, and the sequence's padded length.

    Null, empty and blank texts are their end id alone. Repeated rows are packed each. Sequences are padded to
    SIZE; one whose length is a power of two stays as it is. Other columns of docs are not looked at.
    """
    common.small_batches(docs.sparkSession, 256)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(common.gives_back(_packer(path or tokens.default_path())), _PIECES)


def op6_pack_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_in_order(common.table(spark, sf_dir, "documents"))
