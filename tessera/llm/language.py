"""Operator 5: language by compression against per-language dictionaries.

Each language has a raw-content zstandard dictionary of passages from labelled documents. A text's words, in lower case, are compressed with
every dictionary, in blocks of whole texts, each behind a passage that the dictionary holds, so that in a short text, too, every match counts;
the language with the smallest sum wins. The score is the softmax of the sizes in bits, tempered. A prediction is rejected when the margin to
the next language is narrow: below MARGIN of the least size, at any length, or when its score is below MIN_SCORE.

Fitting looks at a bounded sample: DOCS_PER_LANG documents of each language with the least hashes of doc_id, and of each its first PASSAGE
characters, at most DICT_BYTES bytes a language. Every language of the labels is learned; beyond SAMPLE_DOCS / DOCS_PER_LANG languages each
has fewer documents, so that the sample stays at SAMPLE_DOCS. A text is compressed once for each language, so labels of more than MOST_LANGS languages, which a column
of something else would have, are an error. Predictions read whole texts, all in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common

DOCS_PER_LANG, PASSAGE, DICT_BYTES, SAMPLE_DOCS, MOST_LANGS = 256, 1024, 160_000, 51_200, 1_000
#: Bytes of a text that are compressed at once, and how hard.
BLOCK, LEVEL = 16_384, 9
#: Bytes of its own dictionary that go before a block.
LEAD = 200
#: A byte of margin counts as exp(HEAT) in odds; a score below MIN_SCORE is a narrow margin.
HEAT, MIN_SCORE = 0.35, 0.4
#: The least difference of the two least sizes, over the least. Words of random letters or syllables stay below it but for one
#: in twenty at worst; at most two percent of held-out texts of 128 bytes and more do at sf0.1. Half English, half French texts mostly exceed it.
MARGIN = 0.04
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from; a row without doc_id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """lang -> dictionary, from docs (doc_id, text, lang). Counts first, then a hash threshold keeps what is ranked small. More than MOST_LANGS
    languages raise ValueError."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = docs.groupBy("lang").count()
    langs = max(1, counts.count())
    if langs > MOST_LANGS:
        raise ValueError(f"lang has {langs} different values, of which at most {MOST_LANGS} can be learned: normalise or map the labels first")
    docs_per_lang, dict_bytes = (max(1, min(most, SAMPLE_DOCS * most // (langs * DOCS_PER_LANG))) for most in (DOCS_PER_LANG, DICT_BYTES))
    near = common.bounded(counts.select(F.col("lang").alias("l"), (F.lit(4.0 * docs_per_lang) / F.col("count")).alias("share")), langs)
    h = F.xxhash64("doc_id", F.lit(17))
    some = docs.join(near, F.col("lang") == F.col("l")).where(F.pmod(h, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    some = some.select("lang", "doc_id", h.alias("h"), F.substring("text", 1, PASSAGE).alias("passage"))
    some = some.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "passage"))).where(F.col("n") <= docs_per_lang)
    out: dict[str, list[bytes]] = {}
    for r in some.orderBy("lang", F.desc("n")).collect():  # SAMPLE_DOCS passages at most
        out.setdefault(r.lang, []).append(letters(r.passage))
    return {k: b"\n".join(v)[-dict_bytes:] for k, v in out.items()}


def letters(text: str) -> bytes:
    """The words in lower case, what is no letter between them as one space."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode()


def _predictor(dictionaries: dict[str, bytes], answer):
    """Batches, of which the last column is the text, as what answer makes of them and of the predictions (language, score, margin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        import zstandard as z

        langs = sorted(dictionaries)
        tools = []
        for lang in langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            f = z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress
            lead = dictionaries[lang][:LEAD]
            tools.append((f, lead, len(f(lead))))

        def predict(text: bytes | None) -> tuple[str, float, float]:
            if text is None or not langs or not any(map(str.isalpha, plain := text.decode())):
                return UNKNOWN, 0.0, 0.0
            text = letters(plain)
            blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
            sizes = [sum(len(f(lead + x)) - known for x in blocks) for f, lead, known in tools]
            least = min(sizes)
            best = sizes.index(least)
            margin = (min(sizes[:best] + sizes[best + 1 :], default=math.inf) - least) / max(least, 1)
            return langs[best], 1 / sum(math.exp(-HEAT * min(s - least, 2000)) for s in sizes), margin

        for batch in batches:
            found = [predict(x.as_py()) for x in batch.column(batch.num_columns - 1).cast(pa.large_binary())]
            yield answer(batch, found)

    return run


def _predictions(batch: pa.RecordBatch, found: list[tuple[str, float, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])


def _rejected(batch: pa.RecordBatch, found: list[tuple[str, float, float]]) -> pa.RecordBatch:
    """The keys of rows whose prediction is rejected."""
    gone = pa.array([lang == UNKNOWN or score < MIN_SCORE or margin < MARGIN for lang, score, margin in found], pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["__f", "__i"]).filter(gone)


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text). Null texts and texts without a letter: und, 0.

    Of languages with equal sizes the first by name is taken. Repeated rows give a row each, no docs no rows; without dictionaries all is und.
    Other columns of docs are not looked at.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(common.gives_back(_predictor(dictionaries, _predictions)), "doc_id long, lang_pred string, score double")


def accepted_documents(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of docs (doc_id, text and further columns) whose prediction is not rejected, unchanged; repeated rows as often. A tie is
    a narrow margin."""
    common.small_batches(docs.sparkSession)
    scratch = common.Scratch(docs.sparkSession, "language")
    rows, back = common.renamed(docs, ("doc_id", "text"))
    rows = common.keyed(rows, scratch)
    gone = rows.select("__f", "__i", F.col("text").cast("string").alias("text")).mapInArrow(common.gives_back(_predictor(dictionaries, _rejected)), "__f long, __i long")
    return common.without(rows, gone, scratch).select(*back)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op5_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict_languages(docs, fit(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
