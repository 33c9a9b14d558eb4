"""Operator 12: a Merkle manifest of a dataset, its blocks hashed by DuckDB inside tasks.

Each row is a leaf; the leaves of a source, in the order of doc_id, are the lowest nodes of its tree. While a tree has several nodes, every
FAN consecutive ones become their hash. What remains of the sources, in their order, is a tree of the same kind, and gives the root.

Plan
1. Spark hashes the leaves and writes them, sorted over ranges of (source, doc_id, leaf), so that a source of any size is spread over many
   tasks; counts of the partitions give each row its place.
2. Up: nodes are dealt to buckets aligned at LEVELS levels (BUCKET places). A task hands whole buckets, as Arrow tables, to
   DuckDB, which hashes level by level: string_agg in order, then sha256. A bucket leaves one node, which is written; buckets of these follow until
   every tree has one node. A round makes BUCKET nodes one, so there are three for 10^10 leaves.
3. Down: from the root on, each bucket gets the outer proof of its node, one row, and DuckDB prefixes it with the siblings inside the bucket, level by
   level. Only outer proofs are ever shuffled, one a bucket; the proof of a leaf lives in the task that hashes it, and folds the (tampered) leaf back to the root.

Proofs are lists of levels, each the siblings as hex text with a comma in the place of the own node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import runs

FAN, LEVELS = 16, 3
BUCKET = FAN**LEVELS
#: Rows that are handed to DuckDB at once, in whole buckets.
ROWS = 8_192


def field(c: Column) -> Column:
    """A value as it is hashed: its bytes' number, a colon, and itself; a dash if it is null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def placed(df: DataFrame, order: list[str], scratch: common.Scratch, name: str) -> DataFrame:
    """df with pos: a row's place, from 0, in the order of these columns (nulls first); a written table. Rows equal in all of them take any order."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    in_order = [F.col(c).asc_nulls_first() for c in order]
    sorted_ = scratch.write(df.repartitionByRange(n, *in_order).sortWithinPartitions(*in_order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = {r.part: r.n for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, sum_ = {}, 0
    for k in sorted(counts):
        before[k] = sum_
        sum_ += counts[k]
    if not before:
        return sorted_.withColumn("pos", F.col("__at")).drop("__at")
    starts = df.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    return sorted_.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("pos", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def levels_of(n: Column) -> Column:
    """How many levels a bucket of a tree with n nodes is hashed."""
    out = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        out = F.when(n <= FAN**k, k).otherwise(out)
    return out.cast("int")


def _connect():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _hash_levels(con) -> None:
    """From table l0 (tree, b, pos, digest, levels): the runs' texts s0, s1, ... and the levels l1, l2, ... above."""
    for k in range(LEVELS):
        con.execute(f"CREATE OR REPLACE TEMP TABLE s{k} AS SELECT tree, b, levels, pos // {FAN} AS run, string_agg(digest, '' ORDER BY pos) AS s FROM l{k} WHERE levels > {k} GROUP BY ALL")
        con.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT tree, b, run AS pos, sha256(s) AS digest, levels FROM s{k} UNION ALL SELECT tree, b, pos, digest, levels FROM l{k} WHERE levels <= {k}")


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node that each bucket of sorted rows (tree, b, pos, digest, levels) leaves: tree, pos, digest."""
    con = _connect()
    for rows, _ in runs(batches, ["tree", "b"], ROWS):
        con.register("given", rows)
        con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT * FROM given")
        _hash_levels(con)
        yield from con.sql(f"SELECT tree, b AS pos, digest FROM l{LEVELS} ORDER BY ALL").to_arrow_table().cast(pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())])).to_batches()
        con.unregister("given")


_PATH = "tree long, pos long, path array<string>, subroot string"
_PROVED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded string"


def _down(leaves: bool):
    """Sorted rows (tree, b, pos, digest, levels, doc_id, forged, path, subroot), each bucket with one row without pos, which has the outer proof, as
    _PATH of its nodes, or as _PROVED of its leaves."""
    what = _PROVED if leaves else _PATH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in what.split(", ")])
        for rows, _ in runs(batches, ["tree", "b"], ROWS):
            con.register("given", rows)
            con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT tree, b, pos, digest, levels FROM given WHERE pos IS NOT NULL")
            _hash_levels(con)
            joins, sides = "", []
            for k in range(LEVELS):
                own = f"(g.pos // {FAN**k} % {FAN})"
                joins += f" LEFT JOIN s{k} ON s{k}.tree = g.tree AND s{k}.b = g.b AND s{k}.run = g.pos // {FAN ** (k + 1)}"
                sides.append(f"CASE WHEN s{k}.s IS NOT NULL THEN substr(s{k}.s, 1, 64 * {own}) || ',' || substr(s{k}.s, 64 * {own} + 65) END")
            paths = f"SELECT g.tree, g.pos, g.doc_id, g.digest, g.forged, o.subroot, list_filter([{', '.join(sides)}], lambda x: x IS NOT NULL) || o.path AS path FROM given g JOIN given o ON o.tree = g.tree AND o.b = g.b AND o.pos IS NULL AND g.pos IS NOT NULL{joins}"
            if leaves:
                told = f"SELECT doc_id, digest AS leaf, subroot, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256, list_reduce(path, lambda node, level: sha256(replace(level, ',', node)), forged) AS folded FROM ({paths})"
            else:
                told = f"SELECT tree, pos, path, subroot FROM ({paths})"
            yield from con.sql(told).to_arrow_table().cast(schema).to_batches(4096)
            con.unregister("given")

    return run


def _bucket(pos: Column) -> Column:
    return F.floor(pos / BUCKET).cast("long")


class _Trees:
    """Trees over written nodes (tree, pos, digest, n), n the nodes of the tree: up to one node each, and down again."""

    def __init__(self, nodes: DataFrame, scratch: common.Scratch, name: str, most: int):
        self.scratch, self.name, self.rounds = scratch, name, [nodes]
        while most > 1:
            below = self.rounds[-1].withColumn("b", _bucket(F.col("pos")))
            rows = below.select("tree", "b", "pos", "digest", levels_of(F.col("n")).alias("levels")).repartition("tree", "b").sortWithinPartitions("tree", "b", "pos")
            up = rows.mapInArrow(common.gives_back(_up), "tree long, pos long, digest string")
            sizes = below.groupBy("tree", "b").agg(F.ceil(F.first("n") / BUCKET).cast("long").alias("n")).withColumnRenamed("b", "pos")
            self.rounds.append(scratch.write(up.join(sizes, ["tree", "pos"]), f"{name}-{len(self.rounds)}"))
            most = math.ceil(most / BUCKET)
        self.top = self.rounds[-1].select("tree", F.col("digest").alias("subroot"))

    def paths(self, outer: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lowest nodes, and the paths (tree, pos of the bucket, path, subroot) of their buckets; outer has those of the trees."""
        for k in range(len(self.rounds) - 1, 1, -1):
            outer = self.scratch.write(_descend(self.rounds[k - 1], outer, False), f"{self.name}-path-{k}")
        return self.rounds[0], outer


def _descend(nodes: DataFrame, outer: DataFrame, leaves: bool) -> DataFrame:
    none = F.lit(None)
    doc_id, forged = (F.col("doc_id"), F.col("forged")) if leaves else (none, none)
    own = nodes.select("tree", _bucket(F.col("pos")).alias("b"), "pos", "digest", levels_of(F.col("n")).alias("levels"), doc_id.cast("long").alias("doc_id"), forged.cast("string").alias("forged"), none.cast("array<string>").alias("path"), none.cast("string").alias("subroot"))
    told = outer.select("tree", F.col("pos").alias("b"), none.cast("long").alias("pos"), none.cast("string").alias("digest"), none.cast("int").alias("levels"), none.cast("long").alias("doc_id"), none.cast("string").alias("forged"), "path", "subroot")
    both = own.union(told).repartition("tree", "b").sortWithinPartitions("tree", "b", "pos")
    return both.mapInArrow(common.gives_back(_down(leaves)), _PROVED if leaves else _PATH)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    tampered marks rows whose text is lower-cased (A-Z) before it is folded to the root again; by default those whose unsigned crc32 of doc_id 5 divides.
    Null columns are hashed as a dash; a null source is a source of its own, the first. Within a source rows without doc_id come first, and those with one
    doc_id in the order of their leaves; equal rows are leaves each. A dataset of one row has its leaf as root, and an
    empty proof. No docs give no rows; other columns of docs are not looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "merkle")
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False)) if tampered is None else tampered
    rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], chosen.alias("chosen"))
    head = [F.col(c) for c in list(kinds)[:-1]]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = rows.select("doc_id", "source", leaf_hash(*head, F.col("text")).alias("digest"), F.when(F.col("chosen") & F.col("text").rlike("[A-Z]"), leaf_hash(*head, low)).alias("forged"), F.monotonically_increasing_id().alias("row"))
    leaves = placed(scratch.write(hashed.withColumn("forged", F.coalesce("forged", "digest")), "leaves"), ["source", "doc_id", "digest", "row"], scratch, "sorted")

    by = {"none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}
    leaves = leaves.withColumns(by).drop("source", "row")
    sources = leaves.groupBy("none", "name").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    sources = scratch.write(placed(scratch.write(sources, "sources"), ["first"], scratch, "sorted-sources").withColumnRenamed("pos", "tree"), "trees")
    total = sources.agg(F.count("*").alias("sources"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if total.sources <= common.BROADCAST_ROWS:
        leaves = leaves.join(F.broadcast(sources), ["none", "name"])
    else:
        leaves = common.hot_join(leaves, sources, ["none", "name"], sources.select("none", "name", "n"), total.rows, F.col("pos"))
    leaves = leaves.select("tree", (F.col("pos") - F.col("first")).alias("pos"), "digest", "n", "doc_id", "forged")

    inner = _Trees(scratch.write(leaves, "placed"), scratch, "inner", total.most or 0)
    scratch.drop("leaves", "sorted")
    tops = inner.top.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"), F.lit(total.sources).cast("long").alias("n"))
    outer = _Trees(scratch.write(tops, "subroots"), scratch, "outer", total.sources)
    root = outer.top.first()  # one row
    start = outer.top.select("tree", F.lit(0).cast("long").alias("pos"), F.expr("CAST(array() AS array<string>)").alias("path"), "subroot")
    nodes, paths = outer.paths(start)
    of_trees = scratch.write(_descend(nodes, paths, False).drop("subroot").withColumnRenamed("pos", "of"), "tree-paths")
    of_trees = of_trees.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path").join(inner.top, "tree")
    nodes, paths = inner.paths(of_trees.select("tree", "pos", "path", "subroot"))
    proved = _descend(nodes, paths, True)
    top = F.lit(root.subroot if root else None).cast("string")
    return proved.select("doc_id", "leaf", "subroot", top.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == top).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


def _tree_sql(name: str, source: str, depth: int) -> str:
    """Levels over source (k, pos, digest, n): name_up has the last node of each k, name_path the levels above each lowest node."""
    out = [f"{name}_0 AS (SELECT k, pos, digest, n FROM {source})"]
    for d in range(depth):
        out.append(f"{name}_s{d} AS (SELECT k, pos // {FAN} AS pos, string_agg(digest, '' ORDER BY pos) AS s, any_value(n) AS n FROM {name}_{d} WHERE n > 1 GROUP BY k, pos // {FAN})")
        out.append(f"{name}_{d + 1} AS (SELECT k, pos, sha256(s) AS digest, (n + {FAN - 1}) // {FAN} AS n FROM {name}_s{d} UNION ALL SELECT k, pos, digest, n FROM {name}_{d} WHERE n <= 1)")
    own = [f"pos // {FAN**d} % {FAN}" for d in range(depth)]
    sides = [f"CASE WHEN s{d}.s IS NOT NULL THEN substr(s{d}.s, 1, 64 * (l.{own[d]})) || ',' || substr(s{d}.s, 64 * (l.{own[d]}) + 65) END" for d in range(depth)]
    joins = " ".join(f"LEFT JOIN {name}_s{d} s{d} ON s{d}.k = l.k AND s{d}.pos = l.pos // {FAN ** (d + 1)}" for d in range(depth))
    out.append(f"{name}_path AS (SELECT l.k, l.pos, list_filter([{', '.join(sides)}], lambda x: x IS NOT NULL) AS path FROM {source} l {joins})")
    return ",\n".join(out)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
#: crc32 by its definition, bit after bit; five levels of 16 hold a million rows a source and as many sources.
SQL = rf"""
WITH RECURSIVE crc(doc_id, s, c, bits) AS (
  SELECT DISTINCT doc_id, substr(doc_id::VARCHAR, 2), xor(4294967295, ord(doc_id::VARCHAR))::BIGINT, 8 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, CASE WHEN bits > 0 THEN s ELSE substr(s, 2) END, CASE WHEN bits > 0 THEN {_CRC_STEP} ELSE xor(c, ord(s))::BIGINT END, CASE WHEN bits > 0 THEN bits - 1 ELSE 8 END
  FROM crc WHERE bits > 0 OR s <> ''),
sums AS (SELECT doc_id, xor(c, 4294967295) % 5 = 0 AS chosen FROM crc WHERE bits = 0 AND s = ''),
h AS (
  SELECT d.doc_id, source, sha256({_HEAD.replace('doc_id', 'd.doc_id')} || {_FIELD.format('text')}) AS digest,
    CASE WHEN chosen THEN sha256({_HEAD.replace('doc_id', 'd.doc_id')} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS forged
  FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id),
o AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, * EXCLUDE (source) FROM h),
{_tree_sql('i', 'o', 5)},
t AS (SELECT 0 AS k, k AS pos, digest, count(*) OVER () AS n FROM i_5),
{_tree_sql('u', 't', 5)},
j AS (
  SELECT o.doc_id, o.digest AS leaf, coalesce(o.forged, o.digest) AS folds, t.digest AS subroot, (SELECT digest FROM u_5) AS root, i_path.path || u_path.path AS path
  FROM o JOIN t ON t.pos = o.k JOIN i_path ON i_path.k = o.k AND i_path.pos = o.pos JOIN u_path ON u_path.pos = o.k),
f AS (SELECT *, list_reduce(path, lambda node, level: sha256(replace(level, ',', node)), folds) AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
