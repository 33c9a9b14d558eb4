"""The operators on small frames with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import exact_dup, html_text, language, mixing, near_dup, packing, private_data, quality, token_count, token_output, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, a long, size long, rep long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = {1: BASE, 2: BASE + " phi", 3: BASE.upper(), 4: None, 5: "", 6: " \n\t", 7: "one", 8: "one", 9: "x " * 30_000, 10: "é ß 漢字 " + BASE, 11: BASE[::-1]}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 3 else f"s{i}", 0, "k", 1, 2, 3) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows + rows[:1], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, 2, 80).collect()}
    sets = {i: shingles(t) for i, t in TEXTS.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), root[i], root[i] == i)
    assert near_dup.near_duplicates(none).count() == 0


def test_exact_duplicates(docs, none):
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in TEXTS.items()}
    for r in exact_dup.exact_duplicates(docs).collect():
        same = [i for i in plain if plain[i] == plain[r.doc_id]]
        assert r.keep_id == min(same, key=lambda i: (-len(TEXTS[i] or ""), i))
        assert r.group_size == len(same) + (1 in same)
        assert r.text_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()
    assert exact_dup.exact_duplicates(none).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 1000):
        values = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert (exact_dup.golomb_decode(exact_dup.golomb_encode(values), len(values)) == values).all()


def test_quality(docs, none):
    for r in quality.quality(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 200 else set(windows)
        covered = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert not (r.base_failed and r.kept)
    assert quality.quality(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source_index for r in rows}:
        own = [r for r in rows if r.source_index == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    assert mixing.mixed(none).count() == 0


def test_packing(docs, none):
    tok = Tokenizer.from_file(tokens.default_path())
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in TEXTS.items()}
    rows = packing.pack_in_order(docs).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[1])
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and packing.pack_in_order(none).count() == 0
    for r in token_output.packed_ids(docs).collect():
        row = np.frombuffer(r.input_ids, "<u2")
        for doc, at, lo, hi in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert (row[lo:hi] == ids[doc][at : at + hi - lo]).all()


ODD = ["a", "B", "É", "E\u0301", "H\u0331", "İ", "ß", "ẞ", "Σ", "'s", "'S", "'", "’", ",", "!!", "—", "1", "漢", "\u0338", "\u0307", "\u0085", "\u00a0", "\u212a", "ﬁ", " ", "\t", "\n", "x", "The", "_", "\0", "<|endoftext|>", "<|ENDOFTEXT|>", "😀", "ª", "Ⅷ", "ⓐ"]


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(1)
    texts = [None, ""] + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    tok, got = Tokenizer.from_file(tokens.default_path()), tokens.WordIds(tokens.default_path()).all_ids(pa.array(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_long_texts_are_taken_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["", None, "a", " \n", "x" * 300, *("".join(rng.choice(ODD) for _ in range(rng.randint(1, 400))) for _ in range(300))]
    want = [x.tolist() for x in tokens.WordIds(tokens.default_path()).all_ids(pa.array(texts))]
    monkeypatch.setattr(tokens, "CHUNK", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(tokens.WordIds(tokens.default_path()).documents(iter([batch])))
    assert [i for i, _ in got] == list(range(len(texts))) and [x.tolist() for _, x in got] == want


def test_best_cuts_against_all_ways():
    rng = np.random.default_rng(1)
    for _ in range(30):
        c = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))])
        pen = rng.integers(0, 5, 13)
        f = [0] + [10**9] * 12
        for j in range(1, 13):
            f[j] = min((f[i] + 16 - (c[j] - c[i]) + pen[j] for i in range(j) if c[j] - c[i] <= 16), default=10**9)
        cuts = packing.best_cuts(c, pen, 16)
        at = [int(np.flatnonzero(c == x)[0]) for x in cuts]
        assert sum(16 - (c[j] - c[i]) + pen[j] for i, j in zip(at, at[1:], strict=False)) == f[12]


def test_token_counts(docs, none):
    scores, byte = token_count.unigram_scores(tokens.default_path("piece_bpe_32k.model"))

    def best(word):
        f = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            ways = [(f[b][0] + scores[word[b:d]], -(-f[b][1] + 1)) for b in range(d) if word[b:d] in scores]
            if word[d - 1] not in scores:
                n = len(word[d - 1].encode())
                ways.append((f[d - 1][0] + n * byte, f[d - 1][1] - n))
            f.append(max(ways))
        return -f[-1][1]

    for r in token_count.token_counts(docs).collect():
        words = (TEXTS[r.doc_id] or "").split()
        assert r.n_words == len(words) and r.n_tokens == sum(best("▁" + w) for w in words[:50]) * (len(words) // min(50, len(words) or 1) if r.doc_id == 9 else 1)
    assert token_count.token_counts(none).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict_languages(docs, language.fit(language.training_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_edges(docs, none):
    fitted = {"en": b"alpha beta gamma delta " * 50, "de": b"ist nicht der die das " * 50}
    got = {r.doc_id: r for r in language.predict_languages(docs, fitted).collect()}
    assert all(got[i].lang_pred == "und" for i in (4, 5, 6)) and got[1].lang_pred == "en"
    assert language.accepted_documents(none, fitted).count() == 0 and language.fit(none) == {}


def test_language_rejects_narrow_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(5)
    words = {x.lang: x.w for x in docs.where(language.held_out(F.col("doc_id")) & F.col("lang").isin("en", "fr")).groupBy("lang").agg(F.flatten(F.collect_list(F.split("text", r"\s+"))).alias("w")).collect()}
    words = {k: sorted(v) for k, v in words.items()}

    def of(lang, n):  # drawn one by one, as some documents repeat a word all along
        return " ".join(rnd.choices(words[lang], k=n))

    def invented(parts, most):
        return lambda n: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, most))) for _ in range(n))

    kinds = {
        "junk": invented("abcdefghijklmnopqrstuvwxyz", 9),
        "unlearned": invented("ta nen kaan lla ssa uus yö mi ko poi tu hän jär vi sel kie ka lo".split(), 4),
        "mixed": lambda n: of("en", n // 2) + " " + of("fr", n // 2),
    }
    rows = [(k, n, make(n)) for k, make in kinds.items() for n in (30, 300, 3000) for _ in range(40)]
    fitted = language.fit(language.training_rows(docs))
    frame = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in language.accepted_documents(frame, fitted).select("doc_id").collect()}
    share = {(k, n): sum(i in kept for i, r in enumerate(rows) if r[:2] == (k, n)) / 40 for k in kinds for n in (30, 300, 3000)}
    clean = docs.where(language.held_out(F.col("doc_id")))
    whole = language.accepted_documents(clean, fitted).count() / clean.count()
    assert all(share[k, n] <= 0.1 for k in ("junk", "unlearned") for n in (30, 300, 3000)), share
    assert share["mixed", 3000] < 1 and whole >= 0.94, (share, whole)
    tie = {"aa": b"alpha beta gamma delta " * 50, "bb": b"alpha beta gamma delta " * 50}
    assert language.accepted_documents(frame, tie).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>x<br>y <script>var a='</p>';</script>z<div class=comments>no</div></article><footer>f</footer></body>"
    plain = "<div>site</div><p>own {}</p><div>end</div>"
    rows = [(1, "http://a.b/1", page), (2, "http://c.d/1", plain.format(1)), (3, "http://c.d/2", plain.format(2)), (4, None, None), (5, "http://c.d/2", ""), (2, "http://c.d/1", plain.format(1))]
    got = {(r.page_id, r.text) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert (1, "A & B\n\nx y z") in got and (3, "own 2") in got and (4, "") in got and (5, "") in got


def main_texts(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}


def test_html_differences_articles(spark):
    page = "<body><div>site line</div><article><p>own text of page number {0}, long enough to count {0}</p><p>all rights reserved</p></article><p>outside {0}</p></body>"
    teaser = "<body><article>tiny</article><p>the main text is outside the teaser</p></body>"
    copies = "<body><div>site line</div><article><p>one long article that two pages hold</p><p>edit {}</p></article></body>"
    rows = [(i, f"http://a.b/{i}", page.format(i)) for i in (1, 2)] + [(3, "http://c.d/", teaser)] + [(i, f"http://e.f/{i}", copies.format(i)) for i in (4, 5)]
    got = main_texts(spark, rows)
    assert [got[i] for i in (1, 2)] == [f"own text of page number {i}, long enough to count {i}\n\nall rights reserved\n\noutside {i}" for i in (1, 2)]
    assert got[3] == "tiny\n\nthe main text is outside the teaser"
    assert [got[i] for i in (4, 5)] == [f"one long article that two pages hold\n\nedit {i}" for i in (4, 5)]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=x><title>t</title><body><p>one<p>two",
        "<html><head><title>t</title><p>one<p>two",
        "<html><head><title>t</title>one<p>two",
        "<p>one<svg/><math/><p>two<svg><path/></svg>",
        "<p>one<svg><path><p>two",
        "<article><p>one<p class=notice>no<p>two</article>",
        "<article><p>one<ul><li class=ad>no<li>two</ul></article>",
        "<article><p>one<div><p class=notice>no</div>two</article>",
        "<article><p>one<table><tr><td class=ad>no<td>two</table></article>",
        "<article><p>one<dl><dt class=ad>no<dd>two</dl></article>",
        "<article><p>one<select><option>no</article><p>two",
        "<article><p>one<p>two<ul><li class=comments><ul><li>no</ul>no</ul></article>",
        "<p>one<p>two<nav><ul><li>no<li>no</ul></nav>",
    ],
)
def test_html_end_tags_left_out(page):
    assert html_text.lines(page)[0] == ["one", "two"]


def test_html_attributes_by_name():
    for x in ('style="overflow:hidden"', 'title="the hidden valley"', 'data-role="search"', "data-x='class=ad'", "data-class=ad", "title=class=ad", "aria-hidden=false", "x-hidden"):
        assert html_text.lines(f"<article {x}>text</article>")[0] == ["text"], x
    for x in ("hidden", 'hidden=""', "HIDDEN", "aria-hidden=true", "role = 'search'", 'class="x ad"', "id=ad", 'title="a" class=ad', "a=b/c hidden"):
        assert html_text.lines(f"<article><p {x}>text</p></article>")[0] == [], x


def test_html_neighbours_beyond_copies_and_partitions(spark):
    plain = "<div>site</div><p>own {}</p><div>end</div>"
    numbers = [1, *[2] * 9, 3, *[4] * 5, *[None] * 3, 5, 5, 6]
    rows = [(i, f"http://a.b/{i:02}", plain.format(n) if n else "") for i, n in enumerate(numbers)] + [(90, "http://c.d/", plain.format(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"own {n}" if n else "" for i, n in enumerate(numbers)} | {90: "site\n\nown 9\n\nend"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 7, 30):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html_text.main_text(pages).collect()
            assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want, n
        assert html_text.main_text(pages.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_private_data(docs, none, spark):
    rows = [(i, f"please call number: +1 (702) 555-07{i}2 now") for i in range(8)] + [(20, "please call number: 7025550000 now"), (21, "please call it 7025550001 now"), (22, None), (23, "a@b.c_d@e.f 1.2.3.4 256.1.1.1, 4111 1111 1111 1111")]
    got = {r.doc_id: r for r in private_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20].spans == "phone:20:30" and got[21].spans == "" and got[22].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[23].spans == "email:0:5,email:5:11,ip:12:19,card:31:50"
    assert private_data.personal_data(none).count() == 0 and private_data.personal_data(docs).count() == 12


NO_ID = [(1, BASE), (None, BASE), (None, "solo words here"), (None, None), (2, "solo words here"), (2**60 + 1, BASE + " z"), (None, "only null one"), (None, "only null one")]


@pytest.fixture(scope="module")
def no_id(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, 7, 7) for i, t in NO_ID], "doc_id long, text string, lang string, source string, n_chars long, id long, size long, slot long, words long")


def test_rows_without_ids(no_id):
    near = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(no_id, 2, 80).collect()), key=repr)
    assert near == sorted([(1, 1, True), (None, 1, False), (None, 2, False), (None, None, True), (2, 2, True), (2**60 + 1, 1, False), (None, None, True), (None, None, True)], key=repr)
    exact = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dup.exact_duplicates(no_id).collect()), key=repr)
    assert exact == sorted([(1, 1, 2, True), (None, 1, 2, False), (None, 2, 2, False), (None, None, 1, True), (2, 2, 2, True), (2**60 + 1, 2**60 + 1, 1, True), (None, None, 2, True), (None, None, 2, True)], key=repr)
    assert sorted(r.size for r in mixing.mixed(no_id).collect()) == sorted(len((t or "").split()) for _, t in NO_ID)
    for f in (quality.quality, packing.pack_in_order, token_count.token_counts, private_data.personal_data):
        assert f(no_id).count() == len(NO_ID)


def test_mixing_many_sources(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    documents = pd.DataFrame([(i, "w " * rng.randint(1, 40), f"s{rng.randint(0, 299):03}") for i in range(900)], columns=["doc_id", "text", "source"])
    want = duckdb.sql(mixing.SQL).df()
    got = mixing.mixed(spark.createDataFrame(documents)).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert documents.source.nunique() > mixing.ARRAY_SOURCES
    key = lambda d: [tuple(r) for r in d.sort_values("doc_id").itertuples(index=False)]
    assert [r[:3] + r[4:] for r in key(got)] == [r[:3] + r[4:] for r in key(want)]
    assert np.allclose(got.sort_values("doc_id").target, want.sort_values("doc_id").target)


def test_personal_data_against_plain_patterns(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        return sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(digits))) % 10 == 0

    def valid(kind, x):
        digits = re.sub("[^0-9]", "", x)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in x.split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    some = 0
    for r in private_data.personal_data(docs).collect():
        base = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, texts[r.doc_id]) if valid(k, m[0])] for k, p in patterns.items()}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, base.values()))
        every = [x for k in patterns for x in base[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(every).encode()).hexdigest() and set(every) <= set(r.spans.split(",")) | {""}
        some += len(every)
    assert some
