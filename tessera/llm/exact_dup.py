"""Operator 8: exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each block of documents (the rows of a partition, up to BLOCK_ROWS) keeps its rows in a written table and packs the sorted
   fingerprints of its normalised texts, each once, for each owner: gaps coded by Golomb-Rice with the parameter that fits their
   mean. A fingerprint has SPARE bits more than the number of documents, so one in 2^SPARE documents is taken for a suspect in vain,
   and a gap costs log2(documents / block) + SPARE + 2 bits or less, however many documents there are.
2. Owners (a share of the fingerprint space, set from the number of documents) merge the blocks'
   lists and answer each with a bitmap: which of its fingerprints occur elsewhere too.
3. Only documents whose bit is set, or whose fingerprint occurs twice in their own block, are
   suspects. Their texts are read again and grouped by the full normalised bytes, with map-side
   aggregation, so a group of copies reaches its reducer as one row a task, however large.

A block sends a fingerprint once, so an owner of a text that a third of all rows share gets one entry
a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import SPACE

#: Documents of one block at most, and fingerprints that one owner is to merge.
BLOCK_ROWS, OWNER_ROWS = 131_072, 1_000_000
#: Bits of a fingerprint beyond those of the number of documents.
SPARE = 12
_SPACE_BYTES = SPACE.encode()


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values: Rice parameter, then the low bits of each gap packed, then the quotients in unary."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values) if len(values) else 0
    k = max(0, mean.bit_length() - 1)
    low = gaps & np.uint64((1 << k) - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :].reshape(-1)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    return bytes([k]) + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(data: bytes, n: int) -> np.ndarray:
    k, body = data[0], np.frombuffer(data, np.uint8, offset=1)
    cut = (n * k + 7) // 8
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - k :] = np.unpackbits(body[:cut])[: n * k].reshape(n, k)
    low = np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(body[cut:]))[:n]
    high = np.diff(ends, prepend=-1) - 1
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


_BLOCK = "block long, n int, rows binary, shas binary, nulls binary, slots binary, twice binary, lists array<struct<owner:int,first:int,n:int,coded:binary>>"
_ENTRY = pa.struct([("owner", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("coded", pa.binary())])
_ARROW_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), *((x, pa.binary()) for x in ("rows", "shas", "nulls", "slots", "twice")), ("lists", pa.list_(_ENTRY))])


def _blocks(owners: int, bits: int):
    """Blocks as columns of bytes: rows holds __f, __i, doc_id and characters of each row as longs."""

    def pack(number: int, parts: list) -> pa.RecordBatch:
        rows, nulls, prints, shas = (np.concatenate([p[k] for p in parts]) for k in range(4))
        values, slots, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner = np.array([int(x) * owners >> bits for x in values], np.int64)
        lists, first = [], 0
        for o, n in zip(*np.unique(owner, return_counts=True), strict=True):
            part = values[first : first + n] - np.uint64(-(-(int(o) << bits) // owners))
            lists.append({"owner": int(o), "first": first, "n": int(n), "coded": golomb_encode(part)})
            first += int(n)
        row = {"block": number, "n": len(rows), "rows": rows.tobytes(), "shas": shas.tobytes(), "nulls": nulls.tobytes(), "slots": slots.astype(np.int32).tobytes(), "twice": (counts > 1)[slots].tobytes(), "lists": lists}
        return pa.RecordBatch.from_pylist([row], _ARROW_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts, ids = batch.column(3), batch.column(2)
            n = len(texts)
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), pc.fill_null(ids, 0).to_numpy(), pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64)], 1)
            prints, shas = np.empty(n, np.uint64), np.empty((n, 32), np.uint8)
            for i, x in enumerate(texts.cast(pa.large_binary())):
                plain = (x.as_py() or b"").translate(None, _SPACE_BYTES)
                prints[i] = xxhash.xxh3_64_intdigest(plain) >> (64 - bits)
                shas[i] = np.frombuffer(hashlib.sha256(plain).digest(), np.uint8)
            if n:
                parts.append((rows, np.asarray(pc.is_null(ids).to_numpy(zero_copy_only=False), bool), prints, shas))
                held += n
            if held >= BLOCK_ROWS:
                yield pack(number, parts)
                number, parts, held = number + 1, [], 0
        if parts:
            yield pack(number, parts)

    return run


def _own(group: pa.Table) -> pa.Table:
    """An owner's answer: a bitmap for each block's list."""
    counts = [int(n) for n in group["n"].to_pylist()]
    every = np.concatenate([golomb_decode(x, n) for x, n in zip(group["coded"].to_pylist(), counts, strict=True)])
    values, at, seen = np.unique(every, return_inverse=True, return_counts=True)
    flags = np.split((seen > 1)[at], np.cumsum(counts)[:-1])
    return pa.table({"block": group["block"], "first": group["first"], "n": group["n"], "bitmap": pa.array([np.packbits(x).tobytes() for x in flags], pa.binary())})


_DOCS = "__f long, __i long, doc_id long, n_chars long, sha binary, suspect boolean"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            flags = np.zeros(sum(x["n"] for x in row["answers"]), bool)
            for x in row["answers"]:
                flags[x["first"] : x["first"] + x["n"]] = np.unpackbits(np.frombuffer(x["bitmap"], np.uint8))[: x["n"]]
            suspect = flags[np.frombuffer(row["slots"], np.int32)] | np.frombuffer(row["twice"], bool)
            rows, nulls = np.frombuffer(row["rows"], np.int64).reshape(n, 4), np.frombuffer(row["nulls"], bool)
            shas = pa.Array.from_buffers(pa.binary(32), n, [None, pa.py_buffer(row["shas"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2], mask=nulls), pa.array(rows[:, 3]), shas, pa.array(suspect)], ["__f", "__i", "doc_id", "n_chars", "sha", "suspect"])


def marked(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The columns of exact_duplicates for rows with keys (__f, __i, doc_id, text), with the keys, and `stays`, true for one row of each group."""
    spark = rows.sparkSession
    common.small_batches(spark)
    docs = rows.select("__f", "__i", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = docs.count()
    owners, bits = max(1, -(-count // OWNER_ROWS)), min(64, max(1, count).bit_length() + SPARE)
    blocks = scratch.write(docs.mapInArrow(common.gives_back(_blocks(owners, bits)), _BLOCK), "blocks")

    sent = blocks.select("block", F.explode("lists").alias("x")).select("block", "x.*")
    answers = sent.groupBy("owner").applyInArrow(_own, "block long, first int, n int, bitmap binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("first", "n", "bitmap")).alias("answers"))
    home = blocks.drop("lists").join(answers, "block")
    found = scratch.write(home.select("n", "rows", "shas", "nulls", "slots", "twice", "answers").mapInArrow(common.gives_back(_answered), _DOCS), "rows")
    scratch.drop("blocks")

    some = scratch.write(found.where("suspect").select("__f", "__i"), "suspects")
    texts = docs.join(common.bounded(some, some.count()), ["__f", "__i"], "left_semi")
    text = F.coalesce("text", F.lit(""))
    best = F.min(F.struct((-F.length(text).cast("long")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "__f", "__i"))
    groups = texts.select(F.translate(text, SPACE, "").alias("plain"), "doc_id", "text", "__f", "__i").groupBy("plain").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = scratch.write(groups.select(F.unhex(F.sha2("plain", 256)).alias("sha"), "best", "group_size"), "groups")
    scratch.drop("suspects")
    both = common.hot_join(found.where("suspect"), groups, ["sha"], groups.select("sha", F.col("group_size").alias("n")), count, F.col("__i"))
    both = both.withColumn("stays", (F.col("__f") == F.col("best.__f")) & (F.col("__i") == F.col("best.__i"))).withColumn("keep_id", F.col("best.doc_id"))
    alone = found.where("not suspect").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("stays", F.lit(True))
    columns = ["__f", "__i", "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "stays"]
    return both.select(*columns).union(alone.select(*columns))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Texts are equal when their bytes without ASCII white space are. Null, empty and blank texts are all
    equal. The longest original text stays, then the least doc_id; of repeated rows with one doc_id
    all say kept. Rows without doc_id count as one doc_id, after all others. No docs give no rows. Other columns of docs are not looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "exact")
    return marked(common.keyed(docs.select("doc_id", "text"), scratch), scratch).drop("__f", "__i", "stays")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and further columns) but one of each group of equal texts, unchanged: the longest, then the one with the
    least doc_id, then of repeated rows any one."""
    scratch = common.Scratch(docs.sparkSession, "exact")
    rows, back = common.renamed(docs, ("doc_id", "text"))
    rows = common.keyed(rows, scratch)
    return common.without(rows, marked(rows, scratch).where("not stays"), scratch).select(*back)


def op8_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
w AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS g, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k FROM t)
SELECT doc_id, k AS keep_id, g AS group_size, doc_id = k AS kept, h AS text_sha256 FROM w
"""
