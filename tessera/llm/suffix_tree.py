"""Operator 13: log-probabilities of texts by a probabilistic suffix tree over words, beside a unigram base.

Symbols are the tokens: words, lower-cased (A-Z), one end a text, and one symbol for all words that were not learned; the start is only looked back on.
The root's distribution is the base, (c + 1) / (N + V + 1), which sums to one over the V learned symbols and the unknown one.
A window is a context of up to DEPTH (two) tokens and the next one; words, windows and contexts are known by hashes of 64 bits, so that none
needs a number of its own and no task holds a dictionary of all.

Plan
1. Chunks. Tasks cut their texts into chunks of some TOKENS, written with the numbers of their words among the chunk's different words. Texts are not read again.
2. Counts. A chunk asks the owner of each range of hashes for the counts of its different words and windows (one row a chunk and range, sorted hashes and
   counts), and gets the sums of all chunks back in the same order, so a frequent word is one number a chunk. Longer windows are asked for where both shorter ones within occur LEAST times. Windows that do are entries.
3. Tree (Ron, Singer, Tishby 1996). A context is retained if its next symbols diverge from those of its suffix: n times the Kullback-Leibler
   divergence exceeds the cost of its entries, half the logarithm of n for each. Both are sums over the tokens behind the context, so chunks send
   sums of their own tokens to the contexts' owners, who add them up and decide.
4. The suffixes of retained contexts are retained: their owners are told, and have the last word. Chunks get the decisions on their contexts.
5. Distributions are smoothed by the suffix's: an entry has c / (n + 1), and what is left is shared among the other symbols as the
   suffix's distribution has it, so each sums to one.
6. The longest retained suffix of what precedes a token is its state. A score is the base's plus, token by token, the logarithm of the state's probability over the root's.

Nothing of the tree is broadcast or sent to the driver, and no window of LEAST occurrences is left out, however many there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import runs

#: The longest context, and the least occurrences of a window that makes an entry.
DEPTH, LEAST = 2, 5
#: Bytes of a text that are split at once, tokens of a chunk.
PIECE, TOKENS = 1_000_000, 1_500_000
#: Words and windows that chunks ask one owner for, about.
HELD = 3_000_000
END, START = b"\n", b" "
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_WORDS_KEPT = 500_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from; a row without doc_id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The tokens, some at a time; the end last."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = space.end() if space else len(text)
        if words := text[at:to].lower().split():
            yield words
        at = to
    yield [END]


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def squeezed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits as their bytes by place, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def widened(x: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8).reshape(x[0], -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, : x[0]] = flat.T
    return out.reshape(-1).view(kind)


def short(x: np.ndarray, bits: int = 16) -> np.ndarray:
    """x without so many bits of the 52 behind the leading one, rounded."""
    return (x.view(np.uint64) + np.uint64(1 << (bits - 1))) & ~np.uint64((1 << bits) - 1)


def ascending(x: np.ndarray) -> bytes:
    """Sorted hashes, squeezed as their differences."""
    return squeezed(np.diff(x, prepend=np.uint64(0)))


def ascended(x: bytes) -> np.ndarray:
    return np.cumsum(widened(x, np.uint64), dtype=np.uint64)


_CHUNK = "chunk long, docs array<long>, learns array<boolean>, sizes array<long>, words binary, rank binary, ids binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_CHUNK of rows (doc_id, learns, text): documents with their numbers of tokens, the sorted hashes of the different words, and the tokens as numbers of
    these, by how often they occur, so that frequent words have small numbers, which take less room."""
    from pyspark import TaskContext

    words, chunk = _Words(), TaskContext.get().partitionId() << 32
    docs, flat, n = [], [], 0

    def row() -> pa.RecordBatch:
        ids_, learns, sizes = zip(*docs, strict=True)
        all_, ids, often = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
        rank = np.empty(len(all_), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(all_))
        return _batch([(chunk, list(ids_), list(learns), list(sizes), ascending(all_), squeezed(rank), squeezed(rank[ids]))], _CHUNK)

    for batch in batches:
        for i, learns, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
            size = 0
            for some in pieces(x.as_py() or b""):
                flat.append(np.fromiter(map(words.__getitem__, some), np.uint64, len(some)))
                size += len(some)
            docs.append((i, learns, size))
            n += size
            if n >= TOKENS:
                yield row()
                docs, flat, n, chunk = [], [], 0, chunk + 1
    if docs:
        yield row()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tokens:
    """The tokens of a row of _CHUNK, with hashes of the windows that end there, by length of context, their places in their texts, and whether they are learned from.

    As far as counts of windows are told: c, how often each token's are learned, 0 below bound, and n, how often its contexts are, by length from one on."""

    def __init__(self, r: dict, told: dict[int, list], bound: int):
        words, rank = ascended(r["words"]), widened(r["rank"])
        named = np.empty_like(words)
        named[rank] = words
        self.bound, self.sizes = bound, np.array(r["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.windows = [named[widened(r["ids"])]]
        self.place = np.arange(len(self.windows[0])) - np.repeat(self.first, self.sizes)
        self.learned = np.repeat(np.array(r["learns"], bool), self.sizes)
        for k in range(1, DEPTH + 1):
            self.windows.append(_mixed(self.context(k) * np.uint64(0x9E3779B97F4A7C15) + self.windows[0]))
        self.c: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        if told:
            for k in range(DEPTH + 1):
                where, _, at = self.different(k)
                c = np.zeros(len(self.place), np.int64)
                if len(where) and k not in told:
                    break
                c[where] = np.concatenate([widened(x) for x in told.get(k, [])] or [c[:0]])[at]
                self.c.append(c)
                if k == 0:  # the start is learned as often as the end, which is last
                    self.n.append(np.where(self.place > 0, np.roll(c, 1), c[-1]))
                else:
                    self.n.append(np.where(self.place >= k, np.roll(c, 1), 0))

    def context(self, k: int) -> np.ndarray:
        """Of each token the hash of the k tokens before it; the start counts as one, and nothing is before it."""
        before = np.roll(self.windows[k - 1], 1)
        return before if k > 1 else np.where(self.place > 0, before, np.uint64(xxhash.xxh3_64_intdigest(START)))

    def different(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens whose windows of this length may be entries, as both windows within are, the sorted different windows, and each token's number among these."""
        if k < 2:
            where = np.arange(len(self.place))
        else:
            some = self.c[k - 1] >= self.bound
            where = np.flatnonzero(some & np.roll(some, 1) & (self.place >= k - 1))
        return where, *np.unique(self.windows[k][where], return_inverse=True)

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens whose contexts of this length may have entries, the sorted different contexts, and each token's number among these."""
        where = np.flatnonzero(self.n[k - 1] >= self.bound)
        return where, *np.unique(self.context(k)[where], return_inverse=True)


def _dealt(x: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of these sorted hashes, and where they start and end."""
    key = ((x >> np.uint64(32)) * np.uint64(keys) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], first, np.append(first, len(key))[1:]


#: The kind of a chunk's own row, which stands behind all that the chunk is told.
_OWN = 2 * DEPTH + 1


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, list]]]:
    """Of sorted rows (chunk, kind, key, told, and those of _CHUNK): a chunk's own row, and what it is told, by kind."""
    told: dict[int, list] = {}
    for batch in batches:
        some = batch.column(batch.schema.get_field_index("told"))
        for k, kind in enumerate(batch.column(batch.schema.get_field_index("kind")).to_pylist()):
            if kind < _OWN:
                told.setdefault(kind, []).append(some[k].as_py())
            else:
                yield batch.slice(k, 1).to_pylist()[0], told
                told = {}


def _each(of):
    """of, a function of a chunk and what it is told, for all chunks; what it holds of one is let go before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, told in _by_chunk(batches):
            yield from of(r, told)

    return run


_ASKED = "depth long, key long, chunk long, hashes binary, counts binary"


def _asker(keys: int, bound: int = 0, depths: tuple[int, ...] = (0, 1)):
    """_ASKED of sorted rows of chunks and counts: for each of these lengths and range of hashes the windows of the chunk and how often they are in texts that are learned from."""

    def of(r: dict, told: dict[int, list]) -> Iterator[pa.RecordBatch]:
        t = _Tokens(r, told, bound)
        for depth in depths:
            where, all_, at = t.different(depth)
            counts = np.bincount(at, weights=t.learned[where], minlength=len(all_)).astype(np.int64)
            if len(all_):
                yield _batch([(depth, int(key), r["chunk"], ascending(all_[a:b]), squeezed(counts[a:b])) for key, a, b in zip(*_dealt(all_, keys), strict=True)], _ASKED)

    return _each(of)


_COUNTED = "kind long, key long, chunk long, told binary, words long, tokens long"


def _owner(bound: int):
    """Of sorted rows of _ASKED, as _COUNTED: the sums over all chunks, 0 for those of windows below bound; and of each range of words a row without chunk, with the
    different words that were learned and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, ["depth", "key"], 256):
            for a, b in zip(starts, np.append(starts[1:], len(t)), strict=True):
                of = t.slice(a, b - a)
                hashes = [ascended(x.as_py()) for x in of["hashes"]]
                all_, at = np.unique(np.concatenate(hashes), return_inverse=True)
                sums = np.bincount(at, weights=np.concatenate([widened(x.as_py()) for x in of["counts"]]), minlength=len(all_)).astype(np.int64)
                depth, key, ends = of["depth"][0].as_py(), of["key"][0].as_py(), np.cumsum([len(x) for x in hashes])
                out = [(depth, key, None, None, int((sums > 0).sum()), int(sums.sum()))] if depth == 0 else []
                if depth:
                    sums[sums < bound] = 0
                out += [(depth, key, chunk, squeezed(sums[at[end - len(x) : end]]), None, None) for chunk, x, end in zip(of["chunk"].to_pylist(), hashes, ends, strict=True)]
                yield _batch(out, _COUNTED)

    return run


_JUDGED = "key long, chunk long, depth long, hashes binary, entries binary, n binary, gain binary, above binary, up binary"


def _counter(given):
    """_JUDGED of sorted rows of chunks and counts: for each length and range of hashes the chunk's contexts that can have entries, and the tokens behind them whose
    window is an entry; and of contexts with such tokens how often they are learned, what the tokens gain over the entries' cost, what the suffix gives the entries, and the suffix.
    given: tokens and different words learned, the bound of entries, and the ranges."""

    def of(r: dict, told: dict[int, list]) -> Iterator[pa.RecordBatch]:
        tokens, words, bound, keys = given
        t = _Tokens(r, told, bound)
        up = (t.c[0] + 1) / (tokens + words + 1)
        out = []
        for k in range(1, DEPTH + 1):
            where, all_, at = t.contexts(k)
            own = t.learned[where] & (t.c[k][where] >= bound)
            some, at_ = where[own], at[own]
            c, n = t.c[k][some].astype(float), t.n[k - 1][some].astype(float)
            gain = n / (n + 1) * (np.log(c) - np.log(n + 1) - np.log(up[some])) - np.log(np.maximum(n, 2)) / 2 / c
            sums = lambda v, at_=at_, m=len(all_): np.bincount(at_, weights=v, minlength=m)
            entries, gain, above = sums(np.ones(len(some))).astype(np.int64), sums(gain), sums(up[some] / c)
            n, suffix = np.zeros(len(all_), np.int64), np.zeros(len(all_), np.uint64)
            n[at] = t.n[k - 1][where]
            if k > 1:
                suffix[at] = t.context(k - 1)[where]
            for key, a, b in zip(*_dealt(all_, keys), strict=True):
                some = a + np.flatnonzero(entries[a:b])  # the rest only asks
                out.append((int(key), r["chunk"], k, ascending(all_[a:b]), squeezed(entries[a:b]), squeezed(n[some]), squeezed(short(gain[some], 24)), squeezed(short(above[some])), squeezed(suffix[some])))
            up = np.where(t.c[k] >= bound, t.c[k], 0) / (t.n[k - 1] + 1)
        if out:
            yield _batch(out, _JUDGED)

    return _each(of)


_DECIDED = "key long, chunk long, depth long, hashes binary, state binary, others binary"


def _judge(keys: int):
    """_DECIDED of sorted rows of _JUDGED: of a chunk's contexts whether they have entries (1) and are retained (2), and of those that are, or as suffixes may be, the
    logarithms (base 10) of what other symbols have over what they have in the suffix; and for each range a row without chunk, of suffixes of retained contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, ["depth", "key"], 256):
            for a, b in zip(starts, np.append(starts[1:], len(t)), strict=True):
                of = t.slice(a, b - a)
                hashes = [ascended(x.as_py()) for x in of["hashes"]]
                all_, at = np.unique(np.concatenate(hashes), return_inverse=True)
                whole = lambda c, kind=np.int64, of=of: np.concatenate([widened(x.as_py(), kind) for x in of[c]])
                own = whole("entries")
                n, at_ = np.zeros(len(all_)), at[own > 0]
                n[at_] = whole("n")
                entries = np.bincount(at, weights=own, minlength=len(all_))
                gain, above = (np.bincount(at_, weights=whole(c, float), minlength=len(all_)) for c in ("gain", "above"))
                rest, rest_up = 1 - entries / (n + 1), np.maximum(1 - above, 1e-12)
                some = entries > 0
                kept = some & (gain + n * rest * np.log(rest / rest_up) > 0)
                others = np.log10(rest / rest_up)
                key, depth = of["key"][0].as_py(), of["depth"][0].as_py()
                ends = np.cumsum([len(x) for x in hashes])
                state, out = some.astype(np.int64) + kept, []
                for chunk, x, end in zip(of["chunk"].to_pylist(), hashes, ends, strict=True):
                    own_at = at[end - len(x) : end]
                    told = own_at[state[own_at] > (0 if depth < DEPTH else 1)]  # a suffix may be retained yet
                    out.append((key, chunk, depth, ascending(x) if depth < DEPTH else None, squeezed(state[own_at]), squeezed(short(others[told]))))
                if depth > 1:
                    up = np.unique(whole("up", np.uint64)[kept[at_]])
                    out += [(int(k), None, depth - 1, ascending(up[i:j]), None, None) for k, i, j in zip(*_dealt(up, keys), strict=True)]
                yield _batch(out, _DECIDED)

    return run


_ADDED = "key long, chunk long, depth long, told binary"


def packed(kept: np.ndarray, others: np.ndarray) -> bytes:
    first = squeezed(kept.astype(np.int64))
    return len(first).to_bytes(8, "little") + first + squeezed(others)


def unpacked(x: bytes) -> np.ndarray:
    """others where kept, elsewhere no number."""
    n = 8 + int.from_bytes(x[:8], "little")
    kept = widened(x[8:n]) > 0
    out = np.full(len(kept), np.nan)
    out[kept] = widened(x[n:], float)
    return out


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of _DECIDED as _ADDED: which contexts are retained, those included that a row without chunk names, and what other symbols have there."""
    for t, starts in runs(batches, ["depth", "key"], 256):
        for a, b in zip(starts, np.append(starts[1:], len(t)), strict=True):
            rows = t.slice(a, b - a).to_pylist()
            up = np.unique(np.concatenate([np.zeros(0, np.uint64), *[ascended(r["hashes"]) for r in rows if r["chunk"] is None]]))
            out = []
            for r in rows:
                if r["chunk"] is not None:
                    state, others = widened(r["state"]), widened(r["others"], float)
                    kept = state > 1
                    if r["depth"] < DEPTH:
                        kept |= np.isin(ascended(r["hashes"]), up)
                        others = others[kept[state > 0]]
                    out.append((r["key"], r["chunk"], r["depth"], packed(kept, others)))
            if out:
                yield _batch(out, _ADDED)


_SCORED = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(given):
    """_SCORED of sorted rows of chunks, counts and decisions on contexts (kind: DEPTH and their length). given: as for _counter."""

    def of(r: dict, told: dict[int, list]) -> Iterator[pa.RecordBatch]:
        tokens, words, bound, _ = given
        t = _Tokens(r, told, bound)
        root = (t.c[0] + 1) / (tokens + words + 1)
        gained, open_ = np.zeros(len(root)), np.ones(len(root), bool)
        for k in range(DEPTH, 0, -1):
            where, _, at = t.contexts(k)
            if not len(where):
                continue
            others = np.full(len(root), np.nan)
            others[where] = np.concatenate([unpacked(x) for x in told[DEPTH + k]])[at]
            kept = open_ & ~np.isnan(others)
            hit = kept & (t.c[k] >= bound)
            gained[hit] += np.log10(t.c[k][hit] / (t.n[k - 1][hit] + 1) / root[hit])
            open_ &= ~hit
            gained[kept & ~hit] += others[kept & ~hit]
        sums = lambda v, t=t: np.add.reduceat(v, t.first)
        base = sums(np.log10(t.c[0] + 1.0)) - t.sizes * np.log10(tokens + words + 1)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((r["docs"], r["learns"], t.sizes, sums((t.c[0] > 0).astype(np.int64)), base, base + sums(gained)), _schema(_SCORED), strict=True)], schema=_schema(_SCORED))

    return _each(of)


def scores(docs: DataFrame, learns: Column, least: int = LEAST, share: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and learned of every row of docs (doc_id, text); learns marks those that are learned from.

    Windows that occur least times are entries of the tree, all of them; with share only those that are a share-th of all tokens, too.
    A null or blank text has one token, the end. Repeated rows are counted and scored each. Without rows to learn from, the base gives every token the
    probability one, and so does the tree. No docs give no rows; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    common.small_batches(spark, 256)
    scratch = common.Scratch(spark, "scores")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), learns.alias("learns"), F.col("text").cast("string").alias("text"))
    chunks = scratch.write(rows.mapInArrow(common.gives_back(_chunks), _CHUNK), "chunks")
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    keys = max(1, 4 * rows._jdf.rdd().getNumPartitions(), -(-size // HELD))
    own = chunks.withColumns({"kind": F.lit(_OWN).cast("long"), "key": F.lit(0).cast("long"), "told": F.lit(None).cast("binary")})

    def with_told(*told: DataFrame) -> DataFrame:
        out = own
        for x in told:
            out = out.unionByName(x.select("chunk", "kind", "key", "told"), allowMissingColumns=True)
        return out.repartition("chunk").sortWithinPartitions("chunk", "kind", "key")

    def owned(asked: DataFrame) -> DataFrame:
        return asked.repartition("depth", "key").sortWithinPartitions("depth", "key", "chunk")

    def written(df: DataFrame, name: str) -> DataFrame:
        """df as a table, whose shuffle files go at once."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(key, "false")
        spark.conf.set(key, "true")
        try:
            return scratch.write(df, name)
        finally:
            spark.conf.set(key, before)

    def counted(asked: DataFrame, bound: int, name: str) -> DataFrame:
        return written(owned(asked).mapInArrow(common.gives_back(_owner(bound)), _COUNTED), name)

    counts = counted(own.mapInArrow(common.gives_back(_asker(keys)), _ASKED), least, "counts-1")
    words, tokens = (x or 0 for x in counts.agg(F.sum("words"), F.sum("tokens")).first())
    bound = max(least, -(-tokens // share) if share else 1)
    counts = counts.where("chunk IS NOT NULL")
    for k in range(2, DEPTH + 1):
        asked = with_told(counts).mapInArrow(common.gives_back(_asker(keys, bound, (k,))), _ASKED)
        counts = counts.unionByName(counted(asked, bound, f"counts-{k}"))
    given = tokens, words, bound, keys
    judged = with_told(counts).mapInArrow(common.gives_back(_counter(given)), _JUDGED)
    decided = written(owned(judged).mapInArrow(common.gives_back(_judge(keys)), _DECIDED), "decided")
    added = owned(decided).mapInArrow(common.gives_back(_adder), _ADDED).withColumn("kind", DEPTH + F.col("depth"))
    out = with_told(counts, added).mapInArrow(common.gives_back(_scorer(given)), _SCORED)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(common.table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
