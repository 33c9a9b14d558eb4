"""Operator 10: token counts by dynamic programming on a trie of pre-tokens.

A unigram model scores each piece of a public vocabulary; a pre-token's best segmentation is the one with the
highest sum. The best score of a prefix does not depend on what follows, so pre-tokens are inserted
in a trie and each node's forward score is computed once, when the node is made, from its ancestors;
a pre-token's count stands at its last node. Each task holds its own trie, made anew beyond NODES nodes:
no shuffle, bounded memory.

The model: log-probabilities by Zipf's law over the vocabulary's own order, -log(rank + 2.7). The public vocabularies at hand are BPE
ones, whose pieces have ranks but no probabilities; none are fitted, since tokenizers are not to be trained here. Characters
outside the vocabulary cost one token for each UTF-8 byte. Equal scores take fewer tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, tokens

NODES, WORDS_KEPT = 1_500_000, 400_000
SPACE_MARK = "▁"
#: A byte of an unknown character scores so much below the rarest piece.
BYTE_PENALTY = 10.0


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """piece -> score, and the score of a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {p: -math.log(k + 2.7) for k, p in enumerate(pieces)}
    return scores, min(scores.values()) - BYTE_PENALTY


class Trie:
    """Pre-tokens, with the forward score and the number of tokens at each node."""

    def __init__(self, scores: dict[str, float], byte: float):
        self.scores, self.byte, self.longest = scores, byte, max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The number of tokens of word."""
        if len(self.best) > NODES:
            self.clear()
        path, node = [0], 0
        for d, ch in enumerate(word, 1):
            key = (node, ch)
            node = self.next.get(key, 0)
            if not node:
                node = self.next[key] = len(self.best)
                best, count = -math.inf, 0
                for n in range(1, min(d, self.longest) + 1):
                    if (s := self.scores.get(word[d - n : d])) is not None:
                        total, k = self.best[path[d - n]] + s, self.count[path[d - n]] + 1
                        if total > best or total == best and k < count:
                            best, count = total, k
                if ch not in self.scores:
                    n = len(ch.encode())
                    total, k = self.best[path[d - 1]] + n * self.byte, self.count[path[d - 1]] + n
                    if total > best or total == best and k < count:
                        best, count = total, k
                self.best.append(best)
                self.count.append(count)
            path.append(node)
        return self.count[node]


class _Counts(dict):
    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self[word] = self.trie.insert(SPACE_MARK + word.decode())
        return n


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Trie(*unigram_scores(path)))
        for batch in batches:
            words, sums = [], []
            for x in batch.column(1).cast(pa.large_binary()):
                parts = (x.as_py() or b"").split()
                words.append(len(parts))
                sums.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(sums, np.int64))], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of docs (doc_id, text). Null, empty and blank texts have none of either.

    Repeated rows give a row each, no docs no rows. Other columns of docs are not looked at.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counter(path or tokens.default_path("piece_bpe_32k.model")), "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
