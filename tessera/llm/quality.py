"""Operator 9: quality rules, a table of thresholds compiled into one projection without user functions.

Every figure is an expression over the text; a rule names a ratio of figures with its least and most
value, and a document stays that breaks none. The thresholds are those published with the Gopher
and C4 data sets where these give one, and else set so wide that ordinary prose of any length passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from or an at have not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
}
#: The words as they count: in lower case, with a capital, in capitals.
COUNTED = sorted({form(w) for words in STOP_WORDS.values() for w in words.split() for form in (str, str.capitalize, str.upper)})
#: name, numerator, denominator, least, most, fewest words for which the rule is asked. Of words of prose in the four languages a fifth or more
#: are stop words; the threshold stays far below (the least ratio of a document labelled good at sf0.1 is 0.12). Where fewer than that are stop words, the language may
#: have no list, and the words that the text itself repeats count instead: prose of sixty words repeats its function words in any language, a list of names or codes does not.
RULES = [
    ("mean_word_chars", "word_chars", "n_words", 1.5, 20.0, 10),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.3, 10),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9, 10),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.3, 10),
    ("usual_words", "n_usual_words", "n_words", 0.05, None, 60),
]
#: Base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def figures(text: Column) -> list[dict[str, Column]]:
    """Layers of named expressions; each layer may use the names of those before it."""
    words = F.col("__words")
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)]))
    # positions of windows found twice: sorted by hash, those equal to a neighbour
    pairs = F.array_sort(F.transform(F.col("__windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.array_sort(F.transform(F.filter(F.col("__sorted"), lambda x, i: (F.get("__sorted", i - 1)["h"] == x["h"]) | (F.get("__sorted", i + 1)["h"] == x["h"])), lambda x: x["i"]))
    covered = F.aggregate(F.transform(F.col("__at"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.expr("CAST(array() AS array<int>)")
    return [
        {"__text": F.coalesce(text.cast("string"), F.lit(""))},
        {"__trimmed": F.btrim("__text", F.lit(common.SPACE)), "__lines": F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(common.SPACE)) != "")},
        {"__words": F.when(F.col("__trimmed") == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split("__trimmed", "[\\x20\\x09-\\x0D]+", -1))},
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.translate("__text", common.SPACE, "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("__lines", lambda x: x.rlike("^[ \\t]*[-*\u2022\u2023\u25aa]"))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(COUNTED))).cast("long"),
            "__hashes": F.transform(words, lambda w: F.xxhash64(w)),
        },
        {
            "n_usual_words": F.when(20 * F.col("n_stop_words") >= F.col("n_words"), F.col("n_stop_words")).otherwise((F.size(words) - F.size(F.array_distinct(words))).cast("long")),
            "__windows": F.when(F.size(words) >= WINDOW, hashes).otherwise(F.expr("CAST(array() AS array<bigint>)")),
        },
        {"__sorted": F.when(F.size("__windows") > F.size(F.array_distinct("__windows")), pairs)},
        {"__at": F.when(F.col("__sorted").isNotNull(), at).otherwise(none)},
        {"n_repeat_words": covered},
    ]


def verdict() -> Column:
    """Whether no rule is broken."""
    ok = F.lit(True)
    for _, above, below, least, most, words in RULES:
        ratio = F.col(above) / F.greatest(F.col(below), F.lit(1))
        held = F.lit(True)
        if least is not None:
            held &= ratio >= least
        if most is not None:
            held &= ratio <= most
        ok &= held | (F.col("n_words") < words)
    return ok


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the figures of the contract, base_failed and kept of every row of docs (doc_id, text).

    A null, empty or blank text has no words and fails the base rule. Equal rows give equal rows.
    Other columns of docs are not looked at.
    """
    out = docs.select("doc_id", F.col("text").alias("__given"))
    for layer in figures(F.col("__given")):
        out = out.withColumns(layer)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    parts = []
    for _, above, below, least, most, words in RULES:
        ratio = f"{above}::DOUBLE / greatest({below}, 1)"
        held = [f"{ratio} >= {least}"] * (least is not None) + [f"{ratio} <= {most}"] * (most is not None)
        parts.append(f"(n_words < {words} OR ({' AND '.join(held)}))")
    return " AND ".join(parts)


SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], chr(10)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w))),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g WHERE c > 1) GROUP BY 1),
f AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}\x{{2023}}\x{{25aa}}]')))::BIGINT AS n_bullet_lines,
    len(list_filter(w, lambda x: x IN ({', '.join(map(repr, COUNTED))})))::BIGINT AS n_stop_words, len(list_distinct(w))::BIGINT AS n_different, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CASE WHEN 20 * n_stop_words >= n_words THEN n_stop_words ELSE n_words - n_different END AS n_usual_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM b
"""
