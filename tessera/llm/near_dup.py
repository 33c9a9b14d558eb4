"""Operator 1: near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles. The sketch has T bins. In
round i < T each element throws its i-th hash into a hashed bin; in round T + b every element goes to
bin b. Rounds stop when all bins are filled, so every coordinate fills after 2 T rounds at most, and
usually after one or two; a coordinate is (round, hash), which makes sketches comparable.
(Dahlgaard, Knudsen, Thorup: Fast similarity sketching, FOCS 2017.)

Plan
1. One pass over the texts writes a row number, set size, a 128-bit digest of the set, 32 band keys of four
   coordinates and two bits of each coordinate. Documents with equal sets form a class (digest);
   from here on only the class's least row counts.
2. Band keys are exploded and counted. Each bucket names its least member as pivot; each member is
   verified against the pivot with which it shares most buckets: one pair a member, however large
   the bucket. A pivot with many members is dealt over several tasks, each of which gets its set once. Links give first components.
3. In buckets that still hold several components, members outside the bucket's largest component are compared with all members of
   other components, in blocks inside tasks: first sizes and two-bit sketches only, of which no pair leaves the task, just the
   names of members that have a partner left; then these members' sets, in blocks of a bounded number of hashes a side, which give links.
   A pair that shares several buckets is compared by sets in the first of them only. So no pairs are emitted, a large bucket is
   spread over many tasks, and a set is copied at most 256 times while the members left in its bucket have up to 10^9 hashes together.
Pairs are verified on the full sets, which are made anew from the texts of the documents in pairs.

A pair at the threshold shares no bucket with probability (1 - 0.8^4)^32 = 5e-8. A pair of components that meet in a bucket only, and not at its
pivot, is compared by bits before its sets are: at the threshold 25.6 of 256 bits differ with a deviation of 5.8, so MAX_BITS, 6.5 deviations away,
is exceeded with a computed probability of about 1e-10 (in a test, 800 pairs of 400 shingles at 0.8 differ in 44 bits at most). There is
no exact way round these two chances, which are the only ways to lose a link; there is no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import runs  # by name: what executors run must not hold the module, which names this package

T, ROWS = 128, 4
BANDS = T // ROWS
#: Most differing bits of 256; a pair at 0.8 differs in 25.6 with a deviation of 5.8.
MAX_BITS = 64
#: Members on either side of a block of comparisons by bits: at least, and at most; between the two, a 256th of the bucket, so that a row is copied
#: 256 times at most in buckets of up to 8 million members. Likewise the hashes of the sets on either side of a block of comparisons by sets.
BIT_ROWS, MOST_BIT_ROWS, SET_HASHES, MOST_SET_HASHES = 1024, 32_768, 250_000, 4_000_000
#: Pairs of one block that are compared at once.
PAIRS = 100_000
#: Hashes that are sketched at once.
CHUNK = 400_000
_MAX = np.uint64(2**64 - 1)
_WORDS_KEPT = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles; those of a text of fewer words are one, of none are none."""
    parts = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix((acc + np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates for each non-empty set."""
    n, lens = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), lens)
    out = np.full(n * T, _MAX)
    for i in range(2 * T):
        if i < T:
            h = mix(flat + np.uint64((0xD1B54A32D192ED03 * (i + 1)) % 2**64))
            at = (h & np.uint64(T - 1)).astype(np.int64)
        else:
            h, at = mix(flat ^ np.uint64(i)), i - T
        np.minimum.at(out, owner * T + at, (h >> np.uint64(8)) | np.uint64(i << 56))
        short = (out.reshape(n, T) == _MAX).any(1)
        if not short.any():
            break
        if (keep := short[owner]).sum() < len(owner):
            flat, owner = flat[keep], owner[keep]
    return out.reshape(n, T)


def band_keys(rows: np.ndarray) -> np.ndarray:
    x = rows.reshape(len(rows), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS))
    for i in range(ROWS):
        acc = mix((acc + np.uint64(0x9E3779B97F4A7C15)) ^ x[:, :, i])
    return acc.view(np.int64)


def two_bits(rows: np.ndarray) -> np.ndarray:
    """The two lowest bits of every coordinate, as four longs."""
    bits = np.stack([rows & np.uint64(1), (rows >> np.uint64(1)) & np.uint64(1)], 2).astype(np.uint8)
    return np.packbits(bits.reshape(len(rows), 2 * T), axis=1).copy().view(np.int64)


_SKETCHED = "__f long, __i long, doc_id long, n long, s0 long, s1 long, b0 long, b1 long, b2 long, b3 long, bands array<long>"


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary())
            at = 0
            while at < len(texts):
                sets, size, first = [], 0, at
                while at < len(texts) and (size < CHUNK or not sets):
                    sets.append(shingle_set(texts[at].as_py(), width, words))
                    size += len(sets[-1])
                    at += 1
                yield _rows([batch.column(k).slice(first, at - first) for k in range(3)], sets)

    return run


def _rows(keys: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
    lens = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(lens)
    bands, bits, sig = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), 4), np.int64), np.zeros((len(sets), 2), np.int64)
    if len(full):
        rows = sketch([sets[i] for i in full])
        bands[full], bits[full] = band_keys(rows), two_bits(rows)
    for i in full:
        sig[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
    count = np.where(lens > 0, BANDS, 0)
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(bands[full].reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(lens), *(pa.array(sig[:, k]) for k in (0, 1)), *(pa.array(bits[:, k]) for k in range(4)), lists],
        [x.split()[0] for x in _SKETCHED.split(", ")],
    )


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, len(texts), 64):
                sets = [shingle_set(x.as_py(), width, words).tobytes() for x in texts.slice(at, 64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 64), pa.array(sets, pa.binary())], ["rep", "hashes"])

    return run


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    k = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * k >= percent * (len(p) + len(q) - k)


def _star_checker(percent: int):
    """Links of sorted rows (a, salt, b, hashes): a pivot's own set, with b null, comes before those of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    pivot = np.frombuffer(x.as_py(), np.uint64)
                elif _alike(pivot, np.frombuffer(x.as_buffer(), np.uint64), percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


_BLOCK_KEYS = ["key", "qi", "ri"]


def _candidates(t: pa.Table, starts: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers (asking, told) in the runs of t that sizes, bits and the rule of the first shared bucket leave, some at a time.
    Rows of a run are sorted by asks, so the told ones stand first."""
    asks, minor = (np.asarray(t[x].to_numpy(zero_copy_only=False), bool) for x in ("asks", "minor"))
    key, rep, c, n = (t[x].to_numpy() for x in ("key", "rep", "c", "n"))
    bits = np.stack([t[f"b{k}"].to_numpy() for k in range(4)], 1)
    bands = np.asarray(t["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
    ends = np.append(starts[1:], len(t))
    told_n = np.add.reduceat((~asks).astype(np.int64), starts)
    which = np.repeat(np.arange(len(starts)), ends - starts)
    every = np.flatnonzero(asks)
    counts = told_n[which[every]]
    stops = np.cumsum(counts)
    at = 0
    while at < len(every):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, "right")))
        m, rows = counts[at:to], every[at:to]
        q = np.repeat(rows, m)
        r = np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[which[rows]], m)
        may = (c[q] != c[r]) & (~minor[r] | (rep[r] > rep[q])) & (100 * n[r] >= percent * n[q]) & (100 * n[q] >= percent * n[r])
        q, r = q[may], r[may]
        near = np.bitwise_count((bits[q] ^ bits[r]).view(np.uint64)).sum(1) <= MAX_BITS
        q, r = q[near], r[near]
        if len(q):
            same = bands[q] == bands[r]
            own = bands[q, same.argmax(1)] == key[q]
            yield q[own], r[own]
        at = to


def _bit_checker(percent: int):
    """(key, rep) of the members that have a partner left in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, _BLOCK_KEYS):
            has = np.zeros(len(t), bool)
            for q, r in _candidates(t, starts, percent):
                has[q] = has[r] = True
            yield pa.RecordBatch.from_arrays([t[x].combine_chunks().filter(pa.array(has)) for x in ("key", "rep")], ["key", "rep"])

    return run


def _set_checker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, _BLOCK_KEYS, 256):
            rep, sets, found = t["rep"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]], []
            for q, r in _candidates(t, starts, percent):
                found += [(rep[i], rep[j]) for i, j in zip(q.tolist(), r.tolist(), strict=True) if _alike(sets[i], sets[j], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def marked(rows: DataFrame, scratch: common.Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """The columns of near_duplicates for rows with keys (__f, __i, doc_id, text), with the keys, and `stays`, true for one row of each component."""
    common.small_batches(rows.sparkSession, 256)
    docs = rows.select("__f", "__i", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = scratch.write(docs.mapInArrow(common.gives_back(_sketcher(width)), _SKETCHED).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = all_.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = scratch.write(full.groupBy("s0", "s1").agg(F.min("row").alias("rep"), F.count("*").alias("size"), first), "classes")
    one = scratch.write(full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").withColumnRenamed("row", "rep").drop("doc_id", "s0", "s1"), "one")
    count = one.count()

    def sets_of(ids: DataFrame) -> DataFrame:
        """rep and hashes, made from the texts again."""
        keys = scratch.write(one.join(ids, "rep", "left_semi").select("rep", "__f", "__i"), "wanted")
        some = docs.join(common.bounded(keys, keys.count()), ["__f", "__i"])
        return some.select("rep", "text").mapInArrow(common.gives_back(_setter(width)), "rep long, hashes binary")

    buckets = one.select("rep", F.explode("bands").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = scratch.write(common.hot_join(buckets, pivots.select("key", "pivot"), ["key"], pivots.select("key", "n"), BANDS * count, F.col("rep")), "members")
    star = members.where("rep <> pivot").groupBy("rep", "pivot").count()
    star = scratch.write(star.groupBy("rep").agg(F.max(F.struct("count", F.col("pivot").alias("p")))["p"].alias("a")).select("a", F.col("rep").alias("b")), "star")
    links = scratch.write(_star_links(star, sets_of, count, percent, scratch), "star-links")
    first = scratch.write(common.components(links, scratch, "cc1"), "first")
    scratch.drop("star", "star-links", "star-sets")

    found = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("c"))
    more = _between(scratch.write(found, "found"), one, sets_of, count, percent, scratch)
    joined = more.join(first.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a", "left").join(first.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b", "left")
    second = scratch.write(common.components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch, "cc2"), "second")
    scratch.drop("members", "found", "more")

    placed = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("node", F.coalesce("root", "rep")).drop("root")
    placed = scratch.write(placed, "placed")
    named = common.hot_join(placed, second, ["node"], placed.groupBy("node").agg(F.count("*").alias("n")), count, F.col("s0"), "left")
    named = scratch.write(named.select("s0", "s1", "size", "first", F.coalesce("root", "node").alias("root")), "named")
    best = F.min(F.struct("first.none", "first.doc_id", "s0", "s1", F.col("first.row").alias("row")))
    roots = named.groupBy("root").agg(best.alias("best"), F.count("*").alias("n"))
    named = common.hot_join(named.drop("first"), roots.select("root", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("stay")), ["root"], roots.select("root", "n"), count, F.col("s0"))
    named = scratch.write(named, "told")
    out = common.hot_join(full, named.select("s0", "s1", "component_id", "stay"), ["s0", "s1"], named.select("s0", "s1", F.col("size").alias("n")), count, F.col("row"))
    out = out.select("__f", "__i", "doc_id", "n", "component_id", (F.col("row") == F.col("stay")).alias("stays"))
    out = out.union(all_.where("n = 0").select("__f", "__i", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))
    return out.select("__f", "__i", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "stays")


def _star_links(star: DataFrame, sets_of, count: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """The pairs (a, b) of star that reach the threshold; a is a pivot. Members of a pivot are dealt by salt, and its set goes to each share."""
    sets = scratch.write(sets_of(star.select(F.col("a").alias("rep")).union(star.select("b")).distinct()), "star-sets")
    sizes = star.groupBy("a").agg(F.count("*").alias("n"))
    most = max(common.HOT_ROWS, count // 100_000)
    hot = F.broadcast(sizes.where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    told = star.join(hot, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("salt"), "b")
    told = told.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "salt", "b", "hashes")
    own = sizes.select("a").join(hot, "a", "left").join(sets.withColumnRenamed("rep", "a"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "hashes")
    both = told.union(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(common.gives_back(_star_checker(percent)), "a long, b long")


def _blocks(each: DataFrame, rows: Column, queries: Column, carry: list[str]) -> DataFrame:
    """Rows of buckets dealt to blocks (key, qi, ri), where asking rows meet told rows, told ones first."""
    columns = ["key", F.col("qi").cast("int").alias("qi"), F.col("ri").cast("int").alias("ri"), "asks", "rep", "c", "minor", "n", "b0", "b1", "b2", "b3", "bands", *carry]
    each = each.withColumn("rows", rows.cast("int")).withColumn("queries", queries.cast("int")).withColumn("h", F.xxhash64("rep"))
    asks = each.where("minor").withColumn("qi", F.pmod("h", "queries")).withColumn("ri", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("asks", F.lit(True))
    told = each.where("queries > 0").withColumn("ri", F.pmod("h", "rows")).withColumn("qi", F.explode(F.sequence(F.lit(0), F.col("queries") - 1))).withColumn("asks", F.lit(False))
    return asks.select(*columns).union(told.select(*columns)).repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS, "asks")


def _between(found: DataFrame, one: DataFrame, sets_of, count: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """Links (a, b) between components that meet in a bucket: found has the bucket's key, rep and its component c."""
    sizes = found.groupBy("key", "c").count().groupBy("key").agg(F.max(F.struct("count", "c"))["c"].alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    sizes = scratch.write(sizes.where("all > most"), "sizes")
    open_ = common.hot_join(found, sizes, ["key"], sizes.select("key", F.col("all").alias("n")), BANDS * count, F.col("rep"))
    open_ = open_.select("key", "rep", "c", (F.col("c") != F.col("main")).alias("minor"), "all", "most")
    traits = one.select("rep", "n", "b0", "b1", "b2", "b3", "bands")
    open_ = scratch.write(open_.join(traits, "rep"), "open")
    side = F.least(F.greatest(F.col("all") / 256, F.lit(BIT_ROWS)), F.lit(MOST_BIT_ROWS))
    blocks = _blocks(open_, F.ceil(F.col("all") / side), F.ceil((F.col("all") - F.col("most")) / side), [])
    left = scratch.write(blocks.mapInArrow(common.gives_back(_bit_checker(percent)), "key long, rep long").distinct(), "left")

    each = scratch.write(open_.join(left, ["key", "rep"]).drop("all", "most"), "each")
    scratch.drop("open", "left")
    sums = each.groupBy("key").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("minor"), F.col("n"))), F.lit(0)).alias("asked"), F.count("*").alias("members"))
    sets = scratch.write(sets_of(each.select("rep").distinct()), "open-sets")
    each = common.hot_join(each, sums.drop("members"), ["key"], sums.select("key", F.col("members").alias("n")), BANDS * count, F.col("rep")).join(sets, "rep")
    side = F.least(F.greatest(F.col("all") / 256, F.lit(SET_HASHES)), F.lit(MOST_SET_HASHES))
    blocks = _blocks(each, F.ceil(F.col("all") / side), F.ceil(F.col("asked") / side), ["hashes"])
    out = scratch.write(blocks.mapInArrow(common.gives_back(_set_checker(percent)), "a long, b long").distinct(), "more")
    scratch.drop("open-sets", "each", "sizes")
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Null and blank texts have empty sets and are linked with nothing; equal sets are always linked. Rows with one doc_id are rows of
    their own, each in the component of its text. component_id is the least doc_id in the component, null where no row of it has one; kept
    says whether it is the row's own. No docs give no rows. Other columns of docs are not looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "near")
    return marked(common.keyed(docs.select("doc_id", "text"), scratch), scratch, width, percent).drop("__f", "__i", "stays")


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text and further columns) but one of each component, unchanged: the one with the least doc_id, of rows
    with one doc_id any one whose set is the same."""
    scratch = common.Scratch(docs.sparkSession, "near")
    rows, back = common.renamed(docs, ("doc_id", "text"))
    rows = common.keyed(rows, scratch)
    return common.without(rows, marked(rows, scratch, width, percent).where("not stays"), scratch).select(*back)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2, percent=80)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
same AS (
  SELECT min(doc_id) AS rep, list(doc_id) AS ids, h FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY 1) GROUP BY h),
r AS (SELECT rep FROM same),
t AS (SELECT doc_id, g FROM s WHERE doc_id IN (FROM r)),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
  UNION SELECT rep, unnest(ids) FROM same),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION SELECT u.b, reach.c FROM reach JOIN u ON u.a = reach.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY 1) m ON m.v = d.doc_id
"""
