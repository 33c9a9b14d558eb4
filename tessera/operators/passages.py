"""Texts against a set of passages: which texts hold one verbatim, and which share runs of words with one.

The set is counted first. If it is small it goes to every task, as an automaton of all passages or as the sorted hashes of their runs, and each text is read
once: nothing leaves a task but hits, and no text is shuffled. A larger set is joined by the hashes of runs of words instead. Both ways give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Passages and characters of them that an automaton is made of at most; only the first HEAD characters of a passage are states of it.
MOST_PASSAGES, MOST_CHARS, HEAD = 100_000, 100_000_000, 48
#: Runs whose hashes are broadcast at most, eight bytes each.
MOST_RUNS = 4_000_000
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def contained(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """id of the rows of texts (id, text) that hold the text of a row of passages (text) verbatim.

    Every non-null text holds the empty passage; null texts and null passages hold and are held by nothing. An id is given once, however many of its rows
    hold a passage; null ids count as one.
    """
    p = passages.select(F.col("text").alias("passage")).where("passage IS NOT NULL").distinct()
    size = p.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    if size.n > MOST_PASSAGES or size.chars > MOST_CHARS:
        return by_runs(texts, p)
    held = texts.sparkSession.sparkContext.broadcast([r.passage for r in p.collect()])
    rows = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(_searcher(held), "id long").distinct()


def _searcher(broadcast):
    """Ids of the rows (id, text) whose text holds one of these passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        heads: dict[str, list[str]] = {}
        for x in broadcast.value:
            heads.setdefault(x[:HEAD], []).append(x)
        everything = "" in heads
        automaton = ahocorasick.Automaton()
        for head, whole in heads.items():
            if head:
                automaton.add_word(head, (len(head), [] if head in whole else whole))
        if len(automaton):
            automaton.make_automaton()

        def holds(text: str) -> bool:
            if everything:
                return True
            if not len(automaton):
                return False
            for end, (size, whole) in automaton.iter(text):
                if not whole or any(text.startswith(x, end + 1 - size) for x in whole):
                    return True
            return False

        for batch in batches:
            hit = [holds(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["id"])

    return run


def by_runs(texts: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """As contained, for passages (passage), which are different and not null, too many for an automaton. The second to fifth word of a passage stand as whole words
    in a text that holds it, so texts are looked up by their runs of four words, an equi-join, and only what is found is searched. Passages of fewer
    than six words, which have no such run, are searched in every text, by an automaton of their own for each MOST_PASSAGES of them."""
    split = F.filter(F.split("passage", _SPACES), lambda w: w != "")
    p = passages.withColumn("w", split)
    # a passage that begins or ends with white space has whole words at its ends, too; leaving them out loses nothing
    keys = p.where(F.size("w") >= words + 2).select("passage", F.xxhash64(*[F.get("w", F.lit(1 + i)) for i in range(words)]).alias("gram"))
    w = F.filter(F.split("text", _SPACES), lambda x: x != "")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(words)])))
    t = texts.select("id", "text", w.alias("w")).where(F.size("w") >= words).select("id", "text", F.explode(grams).alias("gram"))
    out = t.join(keys, "gram").where(F.contains("text", "passage")).select(F.col("id").cast("long").alias("id"))
    short = p.where(F.size("w") < words + 2).select("passage")
    parts = -(-short.count() // MOST_PASSAGES)
    rows = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    for k in range(parts):
        some = short.where(F.pmod(F.xxhash64("passage"), F.lit(parts)) == k).collect()
        out = out.union(rows.mapInArrow(_searcher(texts.sparkSession.sparkContext.broadcast([r.passage for r in some])), "id long"))
    return out.distinct()


def overlaps(texts: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """id, item and n: pairs of a row of texts (id, text) and one of passages (item, text) that share runs of so many words, and how many different runs.

    Words are runs of a-z and 0-9 in the text in lower case. Null texts and those of fewer words have no runs. Rows with one id count as one text, as do rows with one item.
    """
    p = passages.select("item", F.lower("text").alias("low")).where("low IS NOT NULL").mapInArrow(_runner("item", words, None), "item long, run string").distinct()
    n = p.count()
    known = None
    if n <= MOST_RUNS:
        import numpy as np

        hashes = p.select("run").distinct().mapInArrow(_hasher, "h long").toArrow()["h"].to_numpy()
        known = texts.sparkSession.sparkContext.broadcast(np.unique(hashes))
    t = texts.select("id", F.lower("text").alias("low")).where("low IS NOT NULL").mapInArrow(_runner("id", words, known), "id long, run string").distinct()
    return t.join(p, "run").groupBy("id", "item").agg(F.count("*").alias("n"))


def _mixed(words: list[str], size: int, known: dict[str, int]):
    """A hash of every run of so many words; known holds words' hashes up to a bound."""
    import numpy as np
    import xxhash

    if len(words) < size:
        return np.empty(0, np.uint64)
    if len(known) > 200_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of runs (one column)."""
    for batch in batches:
        known: dict[str, int] = {}
        found = [int(_mixed(w, len(w), known)[0]) - (1 << 63) for w in (x.as_py().split(" ") for x in batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])


def _runner(name: str, words: int, broadcast):
    """Key and run of the different runs of rows (key, text in lower case); if hashes are broadcast, only of those that have one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np

        token, known = re.compile("[a-z0-9]+"), {}
        wanted = None if broadcast is None else (broadcast.value.view(np.uint64) ^ np.uint64(1 << 63))
        for batch in batches:
            keys, runs = [], []
            for key, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_ = token.findall(low.as_py())
                at = range(len(all_) - words + 1)
                if wanted is not None:
                    h = _mixed(all_, words, known)
                    where = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                    at = np.flatnonzero(wanted[where] == h).tolist() if len(wanted) else ()
                own = {" ".join(all_[i : i + words]) for i in at}
                keys += [key] * len(own)
                runs += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(runs, pa.string())], [name, "run"])

    return run


def curation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language: the first of each group of equal texts, without those that hold a benchmark passage. Hashes and ids are shuffled, not texts;
    one scan hashes and measures every text, another searches it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    held = contained(d.select("id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    least = F.min(F.struct("id", "lang", F.length("text").alias("n")))
    first = d.groupBy(F.sha2("text", 256).alias("h")).agg(least.alias("d")).select("d.*").join(held, "id", "left_anti")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    told = first.join(labels.withColumn("labelled", F.lit(1)), "id", "left")
    return told.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.count("labelled").alias("n_labeled"), F.count(F.when(F.col("quality") == 1, 1)).alias("n_quality"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every pair that shares runs of eight words, and how many distinct ones."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return overlaps(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("item"), "text")).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n")


_GRAMS = "SELECT DISTINCT {k}, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {t}))"
QUERIES = {"curation_summary": curation_summary, "benchmark_overlap": benchmark_overlap}
SQL = {
    "curation_summary": "SELECT d.lang, count(*) AS n_docs, sum(length(d.text))::BIGINT AS n_chars, count(l.doc_id) AS n_labeled, count(CASE WHEN l.quality = 1 THEN 1 END) AS n_quality FROM (SELECT arg_min(text, doc_id) AS text, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)) d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) GROUP BY d.lang",
    "benchmark_overlap": f"SELECT d.doc_id, b.item_id, count(*) AS n FROM ({_GRAMS.format(k='doc_id', t='documents')}) d JOIN ({_GRAMS.format(k='item_id', t='benchmark')}) b ON d.g = b.g GROUP BY 1, 2",
}
