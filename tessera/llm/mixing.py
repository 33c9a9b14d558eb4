"""Operator 3: mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order weigh 5, 2, 1 and so on again; together they get `share` of all
words, none more than `most` times its own, the rest reshared by weight (water filling, solved
in closed form over the table of sources).

Schedule: slot k of the mix takes the golden-ratio point frac((k + 1) / phi); the cumulative targets
map it to a source. The slot's rank among its source's slots is the number of the block that it
takes. A source's documents, shuffled by md5, laid end to end and repeated, are cut into blocks of equal
numbers of words; block r is what slot r of the source takes. Slots and blocks are joined on
(source, number).

Running sums and ranks are taken in two levels (sums of buckets first), so a source that holds a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Slots of a mix: at least so many, until a block holds BLOCK_WORDS words.
LEAST_SLOTS, BLOCK_WORDS = 65_536, 2048
#: Most sources that are searched in an array; more are joined.
ARRAY_SOURCES = 256
#: Rows of one bucket of the two-level sums: the square root of all rows, and so many at least.
BUCKET_ROWS = 1000
#: The conjugate of the golden ratio, in two parts of which the first times 2^20 is exact enough for 10^12 slots.
_PHI = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """idx, source, source_size, target of sizes (source, source_size).

    The windows run over one row a source. A cap binds where the level (what is left, by weight) is above
    cap / weight; sources in the order of that ratio fill up one after another.
    """
    idx = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*map(F.lit, map(float, weights)))
    t = sizes.withColumn("idx", idx).withColumn("w", F.get(weight, F.col("idx") % len(weights))).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    # the first source whose ratio is not below its level sets the level for itself and all after it
    t = t.withColumn("level", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "idx", "level"))).over(W.partitionBy())["level"])
    return t.select("idx", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def bucket_rows(rows: int) -> int:
    return max(BUCKET_ROWS, math.isqrt(rows))


def running(df: DataFrame, key: str, order: list, value: Column, bucket: Column, scratch: common.Scratch, name: str) -> DataFrame:
    """df with __before, the sum of value over the rows of key that come earlier in (bucket, order), and __rank, their number."""
    df = scratch.write(df.withColumn("__bucket", bucket).withColumn("__value", value), name)
    sums = df.groupBy(key, "__bucket").agg(F.sum("__value").alias("s"), F.count("*").alias("c"))
    w = W.partitionBy(key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(key, "__bucket", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"))
    base = scratch.write(base, f"{name}-base")
    own = W.partitionBy(key, "__bucket").orderBy(*order)
    out = df.withColumn("__rank", F.row_number().over(own) - 1).withColumn("__before", F.sum("__value").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("__value"))
    out = out.join(common.bounded(base, base.count()), [key, "__bucket"])
    return out.withColumn("__before", F.col("__before") + F.col("s0")).withColumn("__rank", F.col("__rank") + F.col("c0")).drop("__bucket", "__value", "s0", "c0")


def point(k: Column) -> Column:
    """frac((k + 1) * phi), without losing digits for large k."""
    high, low = F.floor((k + 1) / 1_048_576), (k + 1) % 1_048_576
    step = (_PHI * 1_048_576) % 1.0
    return (high * F.lit(step) + low * F.lit(_PHI)) % 1.0


def schedule(t: DataFrame, slots: int, scratch: common.Scratch) -> DataFrame:
    """k, idx, number of every slot: slot k takes block `number` of source idx."""
    spark = t.sparkSession
    whole = F.sum("target").over(W.partitionBy())
    ends = t.where("target > 0").select("idx", (F.sum("target").over(W.orderBy("idx")) / whole).alias("hi"))
    n, last = ends.agg(F.count("*"), F.max("idx")).first()
    ends = ends.withColumn("lo", F.lag("hi", 1, 0.0).over(W.orderBy("idx"))).withColumn("hi", F.when(F.col("idx") == last, 2.0).otherwise(F.col("hi")))
    ends = scratch.write(ends, "ends")
    points = spark.range(slots).select(F.col("id").alias("k"), point(F.col("id")).alias("u"))
    if n <= ARRAY_SOURCES:  # a search in two constant arrays
        rows = sorted((r.idx, r.hi) for r in ends.collect())
        his, ids = F.array(*[F.lit(float(h)) for _, h in rows]), F.array(*[F.lit(int(i)) for i, _ in rows])
        found = points.select("k", F.get(ids, F.size(F.filter(his, lambda h: h <= F.col("u")))).alias("idx"))
    else:  # an equi-join on cells of [0, 1]; a source lies in all cells that it touches, 6 n rows at most
        cell = lambda u: F.floor(F.least(F.col(u), F.lit(1.0)) * 4 * n)
        spans = ends.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
        found = points.withColumn("cell", cell("u")).join(common.bounded(spans, 6 * n), "cell").where("u < hi AND u >= lo").select("k", "idx")
    out = running(found, "idx", ["k"], F.lit(1), F.floor(F.col("k") / bucket_rows(slots)), scratch, "slots")
    return out.select("k", "idx", F.col("__rank").alias("number"))


def marked(rows: DataFrame, scratch: common.Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The columns of mixed for rows with keys (__f, __i, doc_id, text, source), with the keys."""
    d = rows.select("__f", "__i", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("__t"))
    d = scratch.write(d, "docs")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    t = scratch.write(targets(sizes.select("source", "source_size"), weights, share, most), "targets")
    rows, sources, total = (x or 0 for x in sizes.agg(F.sum("n"), F.count("*"), F.sum("source_size")).first())
    total = t.agg(F.sum("target")).first()[0] or 0.0
    block = int(max(1, min(BLOCK_WORDS, total // LEAST_SLOTS)))
    slots = int(total / block + 0.5)
    d = d.join(common.bounded(t, sources), d.source.eqNullSafe(t.source)).select("__f", "__i", "doc_id", "size", "idx", "source_size", "target", "__t", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("__t").cast("string")))).alias("h"))
    buckets = max(1, -(-rows // bucket_rows(rows)))
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / 2**32)
    d = running(d, "idx", ["h", "doc_id", "size", "__t", "__f", "__i"], F.col("size"), bucket, scratch, "shuffled")
    d = scratch.write(d.withColumnRenamed("__before", "start").withColumnRenamed("__rank", "rank").drop("h", "__t"), "laid")
    scratch.drop("docs", "shuffled", "shuffled-base")

    # where each copy of a document lies in its source's endless line, cut at the ends of the blocks that the schedule takes
    plan = scratch.write(schedule(t, slots, scratch) if slots else t.limit(0).select(F.lit(0).cast("long").alias("k"), "idx", F.lit(0).cast("long").alias("number")), "plan")
    reach = scratch.write(plan.groupBy("idx").agg((F.max("number") + 1).alias("blocks")), "reach")
    copies = d.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.col("start") + F.col("copy") * F.col("source_size"))
    copies = copies.join(common.bounded(reach, sources), "idx").where(F.col("at") < F.col("blocks") * block)
    numbers = F.sequence(F.floor(F.col("at") / block), F.least(F.floor((F.col("at") + F.col("size") - 1) / block), F.col("blocks") - 1))
    pieces = copies.select("idx", "rank", "copy", "at", "size", F.explode(numbers).alias("number"))
    low, high = F.greatest("at", F.col("number") * block), F.least(F.col("at") + F.col("size"), (F.col("number") + 1) * block)
    pieces = pieces.select("idx", "rank", "copy", "number", (low - F.col("at")).alias("first"), (high - low).alias("words"))
    taken = pieces.join(plan, ["idx", "number"])
    taken = taken.groupBy("idx", "rank").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct(F.col("k").alias("slot"), "copy", "first", "words"))).alias("pieces"))
    out = d.join(taken, ["idx", "rank"], "left")
    return out.select("__f", "__i", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("idx").alias("source_index"), "pieces")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """All of docs (doc_id, text, source) as one row a document, with its source's target and the words that the mix takes of it.

    doc_id, size, source_size, target, taken, source_index, and pieces: (slot, copy, first word, words) of each
    piece in the mix, first word counted from 0. Null text has no words and no pieces; null source is a
    source, the last. Repeated rows and rows without doc_id are documents of their own. Empty docs give no rows. Other columns are not looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "mix")
    return marked(common.keyed(docs.select("doc_id", "text", "source"), scratch), scratch, weights, share, most).drop("__f", "__i")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, in the order of its schedule: rows of docs (doc_id, text, source, n_chars and further columns) as often as it takes them, up
    to twice; the last that a source gives may be cut after the words that were taken, and then has its own n_chars."""
    scratch = common.Scratch(docs.sparkSession, "mix")
    rows, back = common.renamed(docs, ("doc_id", "text", "source", "n_chars"))
    rows = common.keyed(rows, scratch)
    pieces = marked(rows, scratch).select("__f", "__i", "size", F.explode("pieces").alias("p"))
    copies = pieces.groupBy("__f", "__i", "size", "p.copy").agg(F.min("p.slot").alias("__slot"), F.sum("p.words").alias("__words"))
    copies = scratch.write(copies.withColumnRenamed("size", "__size").drop("copy"), "copies")
    told = copies.agg(F.count("*").alias("n"), F.max("__slot").alias("last")).first()
    both = rows.join(common.bounded(copies, told.n), ["__f", "__i"])
    words = F.split(F.btrim("text", F.lit(common.SPACE)), "[\\x20\\x09-\\x0D]+", -1)
    text = F.when(F.col("__words") < F.col("__size"), F.array_join(F.slice(words, 1, F.col("__words").cast("int")), " ")).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__words") < F.col("__size"), F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    # blocks are of equal tokens, so equal ranges of slots are of equal size, and need no sample of the texts
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    part = F.floor(F.col("__slot") * n / ((told.last or 0) + 1)).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("__slot").select(*back)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
s2 AS (SELECT *, [5.0, 2.0, 1.0][1 + idx % 3]::DOUBLE AS w, {MOST} * n AS cap, ({SHARE} * (SELECT sum(n) FROM s))::DOUBLE AS whole FROM s),
fill AS (  -- round by round: sources above their cap are fixed
  SELECT 0 AS round, [-1]::BIGINT[] AS fixed, (SELECT max(whole) / sum(w) FROM s2) AS level
  UNION ALL
  SELECT round + 1, f, (SELECT (max(whole) - coalesce(sum(cap) FILTER (list_contains(f, idx)), 0)) / (sum(w) FILTER (NOT list_contains(f, idx))) FROM s2)
  FROM (SELECT round, fixed, (SELECT list(idx) FROM s2 WHERE list_contains(fixed, idx) OR cap / w < level) AS f FROM fill)
  WHERE f IS NOT NULL AND len(f) > len(list_filter(fixed, lambda x: x >= 0))),
level AS (SELECT level FROM fill ORDER BY round DESC LIMIT 1),
t AS (SELECT *, least(cap::DOUBLE, (SELECT level FROM level) * w) AS target FROM s2),
b AS (SELECT greatest(1, least({BLOCK_WORDS}, floor(sum(target) / {LEAST_SLOTS})))::BIGINT AS block, sum(target) AS total FROM t),
e AS (SELECT idx, target, sum(target) OVER (ORDER BY idx) / (SELECT total FROM b) AS hi FROM t),
p AS (SELECT (((k + 1) // 1048576) * (({_PHI}::DOUBLE * 1048576) % 1.0) + ((k + 1) % 1048576) * {_PHI}::DOUBLE) % 1.0 AS u FROM range((SELECT round(total / block)::BIGINT FROM b)) r(k)),
c AS (SELECT least((SELECT count(*) FROM e WHERE target > 0 AND hi <= u), (SELECT count(*) FROM e WHERE target > 0) - 1) AS j, count(*) AS n FROM p GROUP BY 1),
q AS (SELECT idx, coalesce(c.n, 0) * (SELECT block FROM b) AS reach FROM (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS j FROM e WHERE target > 0) LEFT JOIN c USING (j)),
l AS (
  SELECT d.doc_id, d.size, t.n, t.target, coalesce(q.reach, 0) AS reach,
    sum(d.size) OVER (PARTITION BY t.idx ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (idx))
SELECT doc_id, size, n AS source_size, target,
  (greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - start - n)))::BIGINT AS taken FROM l
"""
