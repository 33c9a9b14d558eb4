"""Token ids of whole texts, word by word: shared by the packing operators.

The tokenizer's white space is never part of a token, so the ids of a text are those of its words end to
end. Texts are taken in chunks: each distinct word of a chunk is encoded once, unless its ids are still known from the chunks before, and a gather
puts the ids in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a chunk; a longer text is taken in several, cut at white space.
CHUNK = 4_000_000
#: White space, between words.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words whose ids are kept for the next chunks.
KEPT = 600_000
#: Words whose ids are put in order at once.
GATHERED = 200_000
#: Words that are encoded in one call.
CALL = 4000
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
#: Words that the tokenizer splits into their letters and the marks behind them (all of ASCII but the apostrophe), and only lowers otherwise.
PLAIN = f"^{_LETTERS}+$|^{_LETTERS}*[A-Za-z]{_MARKS}+$"
#: The id that ends a document.
END = 1


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        plain = Tokenizer(tokenizer.model)  # shares the model's memory
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._encode, self._many, self._many_plain = tokenizer.encode, tokenizer.encode_batch_fast, plain.encode_batch_fast
        self.vocab = tokenizer.get_vocab
        self._ends = np.zeros(max(self.vocab().values()) + 1, bool)
        self._known = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        self._ends[[i for piece, i in self.vocab().items() if piece.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _runs(self, encode, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and each word's number of them. Each word gives one run of ids with an end-of-word id behind it;
        a call whose runs do not add up is made again word by word."""
        ids, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(words), CALL):
            some = words.slice(at, CALL).to_pylist()
            got = np.array(encode([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
            stops = np.flatnonzero(self._ends[got]) + 1
            n = np.diff(stops, prepend=0)
            if len(stops) != len(some) or stops[-1] != len(got):
                got, n = self._each(some)
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and each word's number of them."""
        is_plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        is_alpha = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & ~is_plain & ~pc.match_substring(words, "İ").to_numpy(zero_copy_only=False)
        own = ~is_plain & ~is_alpha
        apart = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(is_plain))), r"^(\pL+)(\PL+)$", r"\1 \2"), " ")
        parts = apart.flatten().dictionary_encode()  # many words differ in case or marks only
        ids, n = _gather(*self._runs(self._many_plain, parts.dictionary), parts.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(pc.list_value_length(apart).to_numpy())])]
        kinds = [(ids, np.diff(bounds)), self._runs(self._many, words.filter(pa.array(is_alpha))), self._each(words.filter(pa.array(own)).to_pylist())]
        order = np.concatenate([np.flatnonzero(x) for x in (is_plain, is_alpha, own)])
        return _gather(np.concatenate([x[0] for x in kinds]), np.concatenate([x[1] for x in kinds]), np.argsort(order))

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and counts of all words that are known, end to end, and the place of each of words among them."""
        known, ids, counts = self._known
        at = pc.index_in(words, known)
        new = words.filter(pc.is_null(at))
        more_ids, more_counts = self._encoded(new)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(known) + np.arange(len(new))
        ids, counts = np.concatenate([ids, more_ids]), np.concatenate([counts, more_counts])
        if len(known) + len(new) <= KEPT:
            self._known = pa.concat_arrays([known, new]), ids, counts
        else:
            self._known = words, *_gather(ids, counts, place)
            if len(words) > KEPT:
                self._known = words.slice(0, KEPT), self._known[1][: self._known[2][:KEPT].sum()], self._known[2][:KEPT]
        return ids, counts, place

    def all_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id; null is an empty text."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded, words = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy()
        del lists  # as large as the texts and more
        ids, counts, place = self._looked_up(coded.dictionary)
        index = place[coded.indices.to_numpy()]
        ends = np.cumsum(words)
        for at, to in _chunks(words, GATHERED):
            flat, n = _gather(ids, counts, index[ends[at] - words[at] : ends[to - 1]])
            stops = np.concatenate([[0], np.cumsum(n)])[ends[at:to] - ends[at] + words[at]]
            yield from np.split(np.insert(flat, stops, END), (stops + np.arange(1, len(stops) + 1))[:-1])

    def long_ids(self, text: pa.LargeStringScalar) -> np.ndarray:
        """The ids of one text, with the end id, a chunk of words at a time."""
        raw, at, ids = memoryview(text.as_buffer()), 0, []
        while at < len(raw):
            space = SPACE.search(raw, at + CHUNK)
            to = space.end() if space else len(raw)
            ids.extend(x[:-1] for x in self.all_ids(pa.array([bytes(raw[at:to])], pa.large_binary())))
            at = to
        return np.concatenate([*ids, np.array([END], "<u4")])

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of every row of batches (doc_id, text), in their order."""
        held, size = [], 0

        def give() -> Iterator[tuple[int | None, np.ndarray]]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for at, to in _chunks(pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(), CHUNK):
                part = rows.slice(at, to - at)
                texts = part.column(1).combine_chunks()
                is_long = len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > CHUNK
                yield from zip(part.column(0).to_pylist(), [self.long_ids(texts[0])] if is_long else self.all_ids(texts), strict=True)
                pa.default_memory_pool().release_unused()

        for batch in batches:
            if batch.num_rows:
                held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string())], ["doc_id", "text"]))
                size += batch.nbytes
            if size >= CHUNK:
                yield from give()
                size = 0
        if held:
            yield from give()
        pa.default_memory_pool().release_unused()  # the worker lives on


def _gather(ids: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and counts of the words in index; ids: those of words 0, 1, ... end to end, counts of them."""
    n = counts[index]
    stops = np.cumsum(n)
    shift = (np.cumsum(counts) - counts)[index] - (stops - n)
    return ids[np.repeat(shift, n) + np.arange(n.sum())], n


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to most at most, or of one row."""
    at = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def sentence_ends(vocab: dict[str, int]) -> np.ndarray:
    """For each id whether it ends a word with a full stop, question or exclamation mark."""
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        if piece.endswith("</w>") and piece[:-4].rstrip("\"')]")[-1:] in (".", "!", "?"):
            out[i] = True
    return out


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
