"""Operator 11: fill-in-the-middle documents by a two-pass streaming matcher.

A text is cut into lines with their ends. A first pass over its matches counts them; a second advances a lazy match iterator to the two ranks
drawn for the document and notes where these matches end. Nothing but the two places is kept, so a text of very many lines needs
no more memory than its bytes. The matcher runs over the bytes of the Arrow batch itself: in UTF-8 a line ends where it does by code points.

Ranks and form are drawn from a digest of seed and doc_id, so that they do not depend on where or how often a row is computed. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

UNIT = re.compile(rb"[^\n]*+\n|[^\n]++")
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARKED = re.compile(b"|".join((PREFIX, SUFFIX, MIDDLE)))
#: What is no first byte of a code point.
_INNER = bytes(range(0x80, 0xC0))
#: Bytes of output that are sent on together; a longer text is sent alone.
CHUNK = 4_000_000
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document; a row without doc_id has those of an empty one."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(told[k : k + 4], "big") for k in (0, 4, 8, 12))


def cut(text: memoryview, h1: int, h2: int) -> tuple[int, int, int]:
    """The number of units, and the places where the prefix and the middle end."""
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    matches, at, ends = UNIT.finditer(text), 0, []
    done = 0
    for rank in (low, high):
        while done < rank:
            at, done = next(matches).end(), done + 1
        ends.append(at)
    return n, ends[0], ends[1]


def _chars(part: memoryview) -> int:
    return len(bytes(part).translate(None, _INNER))


def transformed(text: memoryview, doc_id: int | None, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    n, a, b = cut(text, h1, h2)
    if not n or h3 % 100 >= percent or _MARKED.search(text):
        return n, "plain", None, None, bytes(text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, _chars(prefix), _chars(middle), b"".join(parts)


def _transformer(seed: int, percent: int, spm_percent: int):
    def out(held: list) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
        columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)]
        columns[5] = columns[5].view(pa.string())  # the bytes are those of the input, in another order
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")
                held.append((doc_id, *transformed(text, doc_id, seed, percent, spm_percent)))
                size += len(text)
                if size >= CHUNK:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output of every row of docs (doc_id, text).

    form is psm (<P>prefix<S>suffix<M>middle), spm (<S>suffix<P>prefix<M>middle) or plain: the text as it is, when it is null (then empty) or
    empty, holds a marker, or is not among the percent that are transformed. Parts may be empty. Repeated rows give equal rows, rows without doc_id
    are drawn as if it were empty. No docs give no rows; other columns of docs are not looked at.
    """
    common.small_batches(docs.sparkSession, 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.gives_back(_transformer(seed, percent, spm_percent)), _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. A transformed text holds no marker, so each marker stands in its output once."""
    tail = F.substring_index(output, MIDDLE.decode(), -1)
    head = lambda first, second: F.substring(F.substring_index(output, second, 1), len(first) + 1, 2**31 - 1)
    between = lambda mark: F.substring_index(F.substring_index(output, mark, -1), MIDDLE.decode(), 1)
    p, s = PREFIX.decode(), SUFFIX.decode()
    return F.when(form == "psm", F.concat(head(p, s), tail, between(s))).when(form == "spm", F.concat(between(p), tail, head(s, p))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _h(k: int) -> str:
    return f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"


SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM t),
r AS (SELECT *, len(u) AS n, least({_h(0)} % (len(u) + 1), {_h(1)} % (len(u) + 1)) AS a, greatest({_h(0)} % (len(u) + 1), {_h(1)} % (len(u) + 1)) AS b FROM u),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_h(2)} % 100 >= 100 THEN 'plain' WHEN {_h(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
