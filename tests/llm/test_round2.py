"""Repeated ids, hot groups, former limits, and plain versions of what the operators compute."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, exact_dup, html_text, language, mixing, near_dup, private_data, token_output, tokens
from tests.llm.test_operators import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in "ka ke ki ko ku la le li lo lu".split()]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# near and exact duplicates


def components_of(texts, k):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_of_chained_families(spark, monkeypatch):
    """Families whose members differ by so much that components meet in buckets; blocks of a few rows, so that all are split."""
    monkeypatch.setattr(near_dup, "BIT_ROWS", 8)
    monkeypatch.setattr(near_dup, "SET_HASHES", 600)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rnd, rows = random.Random(4), []
    for _ in range(5):
        base = prose(rnd, 150).split()
        for _ in range(30):
            own = list(base)
            for _ in range(rnd.choice((1, 4, 9, 14))):
                own[rnd.randrange(150)] = rnd.choice(WORDS)
            rows.append((len(rows) % 140, " ".join(own)))  # the last ten repeat ids of the first
    rows += [(200, ""), (200, ""), (201, None)]
    root = components_of([t for _, t in rows], 2)
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, len(shingles(t, 2)), least[r]) for r, (i, t) in zip(root, rows, strict=True))
    got = near_dup.near_duplicates(frame(spark, rows), 2, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len(set(root)) > 12  # some families fall apart


def test_one_cluster_of_thousands(spark):
    rnd = random.Random(9)
    base = prose(rnd, 120).split()
    rows = []
    for i in range(5000):
        own = list(base)
        own[rnd.randrange(120)] = rnd.choice(WORDS)
        rows.append((i, " ".join([*own, f"x{i}"])))
    rows += [(5000 + i, prose(rnd, 60)) for i in range(200)]
    got = near_dup.near_duplicates(frame(spark, rows), 5, 80).collect()
    assert {r.component_id for r in got if r.doc_id < 5000} == {0} and sum(r.kept for r in got) == 201


def test_exact_duplicates_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(exact_dup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(exact_dup, "OWNER_ROWS", 2)
    low = -(2**63)
    rows = [(low, "a b"), (3, "ab"), (5, "A"), (5, "B"), (7, "B "), (7, "B "), (2**63 - 1, "ab "), (None, "z")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dup.exact_duplicates(frame(spark, rows)).collect())
    assert got == sorted([(False, low, low, 3, True), (False, 3, low, 3, False), (False, 5, 5, 1, True), (False, 5, 7, 3, False), (False, 7, 7, 3, True), (False, 7, 7, 3, True), (False, 2**63 - 1, low, 3, False), (True, 0, None, 1, True)])


def test_golomb_lists_are_short():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2 ** (30 + exact_dup.SPARE), 100_000, dtype=np.uint64))
    assert len(exact_dup.golomb_encode(values)) * 8 / len(values) < 30 + exact_dup.SPARE - math.log2(len(values)) + 2.2


# the pipeline


def test_rows_are_dropped_by_place(spark):
    long = "the {} of a long enough text that nobody else has written in just these words {}"
    a, b, c = (long.format(x, x * 3) for x in "ABC")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, c + " ")]
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        out = stage(spark, frame(spark, rows), "").collect()
        assert sorted(r.text.strip() for r in out) == sorted([a, b, c]), stage
    odd = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, __f long, __i long, stays long, row long")
    out = corpus_pipeline.exact_copies(spark, odd, "")
    assert out.columns == odd.columns and sorted(r.text.strip() for r in out.collect()) == sorted([a, b, c])


def test_run_keeps_unique_texts(spark, tmp_path):
    """The whole pipeline over a small folder: what run packs is what the stages say one after another."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    again = docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit("\n")))
    docs.union(docs.limit(20)).union(again).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got == [] or max(r.offset + r.length for r in got) <= 2048
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(r.doc_id for r in rows.collect())


def test_mixing_stage_against_its_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan, texts = mixing.mixed(docs).collect(), {r.doc_id: r for r in docs.collect()}
    want = collections.Counter()
    for r in plan:
        copies = collections.defaultdict(list)
        for p in r.pieces or ():
            copies[p.copy].append(p)
        for ps in copies.values():
            n = sum(p.words for p in ps)
            assert sorted((p.first, p.first + p.words) for p in ps)[0][0] == 0  # from the first word on, without gaps
            text = texts[r.doc_id].text
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            want[r.doc_id, text if n == r.size else " ".join(words[:n])] += 1
    out = corpus_pipeline.mixed_sources(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == want and all(r.n_chars == len(r.text) for r in out)


def test_mixing_few_sources_against_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(8)
    for sizes in ((1, 1, 5000), (0, 3, 3), (70_000, 2, 90)):
        documents = pd.DataFrame([(i, "w " * n, f"s{i % 3}") for i, n in enumerate(sizes * 3)] + [(9, "w " * rng.randint(1, 50), None)], columns=["doc_id", "text", "source"])
        want = duckdb.sql(mixing.SQL).df().sort_values("doc_id")
        got = mixing.mixed(spark.createDataFrame(documents, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id")
        assert got.taken.tolist() == want.taken.tolist() and np.allclose(got.target, want.target)


# language


def test_predictions_recomputed(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fitted = language.fit(language.training_rows(docs))
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(docs, fitted).collect()}
    kept = {r.doc_id for r in language.accepted_documents(docs, fitted).collect()}
    for r in docs.limit(40).collect():
        text, sizes = re.sub(r"[\W\d_]+", " ", r.text.lower()).encode(), {}
        for lang, words in fitted.items():
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=language.LEVEL)
            press = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress
            lead = words[: language.LEAD]
            sizes[lang] = sum(len(press(lead + text[at : at + language.BLOCK])) - len(press(lead)) for at in range(0, len(text), language.BLOCK))
        one, two = sorted(sizes.values())[:2]
        assert got[r.doc_id] == min(sorted(sizes), key=sizes.get)
        if not (two - one) / one >= language.MARGIN:
            assert r.doc_id not in kept


def test_every_language_is_learned(spark, monkeypatch):
    rnd = random.Random(2)
    alphabets = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(230)]
    rows = [(i, " ".join("".join(rnd.choice(a) for _ in range(5)) for _ in range(80)), f"l{k:03}") for i, (k, a) in enumerate((k, a) for k, a in enumerate(alphabets) for _ in range(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(docs)) == 230
    monkeypatch.setattr(language, "SAMPLE_DOCS", 230)
    assert len(language.fit(docs)) == 230


def test_long_text_is_read_to_its_end(spark):
    fitted = {"en": b"alpha beta gamma delta " * 50, "de": b"ist nicht der die das " * 50}
    text = "alpha beta " * 40 + "ist nicht der die das " * 40_000
    rows = [(1, text), (1, text), (2, "ist nicht " * 51), (3, "ist nicht " * 52)]
    assert {r.lang_pred for r in language.predict_languages(frame(spark, rows), fitted).collect()} == {"de"}


# html


def test_html_names_and_raw_elements():
    for page, want in (
        ("<article class='social-science'><p>a<section class=related-work>b</section></article>", ["a", "b"]),
        ("<article><p>a<iframe src=x /><p>b</article>", ["a", "b"]),
        ("<p>a<iframe src=y>z</iframe>b<textarea>c</textarea><iframe>d", ["abd"]),
        ("<p>a<noscript>b", ["ab"]),
        ("<p>a<script>b<p>c", ["a"]),
        ("<p>a<script src=x></script>b<style>c</style>", ["ab"]),
        ("<p>a</p><div class='comment-list'>x</div><div id=cookie_banner>y</div><div class=ad-300x250>z</div><div class=site-footer>w</div>", ["a"]),
        ("<html><head><title>t</title><body><p>Hello world</p>", ["Hello world"]),
        ("<p>one<p class=notice>cookie<p>two<p>three", ["one", "two", "three"]),
    ):
        assert html_text.lines(page)[0] == want, page


def test_shared_lines_against_plain_lcs():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        f = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                f[i + 1][j + 1] = f[i][j] + 1 if x == y else max(f[i][j + 1], f[i + 1][j])
        got = sorted(html_text.shared(a, b))
        rest = iter(b)
        assert len(got) == f[-1][-1] and all(a[i] in rest for i in got)  # a common subsequence, and a longest one


def test_html_edges(spark):
    schema = "page_id long, url string, html string, host string, path string, text string, lines string, part int"
    long = "<article>" + "".join(f"<p>line {i} of it" for i in range(60_000)) + "</article>"
    rows = [(1, "http://a.b/x", long, "h", "p", "t", "l", 1), (1, "http://a.b/x", long, "h", "p", "t", "l", 1), (None, None, None, None, None, None, None, None)]
    got = html_text.main_text(spark.createDataFrame(rows, schema)).collect()
    text = "\n\n".join(f"line {i} of it" for i in range(60_000))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(0, "", 0), (1, text, len(text)), (1, text, len(text))])
    assert html_text.main_text(spark.createDataFrame([], schema)).collect() == []


def test_html_tie_takes_the_page_before(spark):
    """The middle page shares one line with each neighbour, and its path as much with both."""
    page = "<div>{}</div><p>own {}</p><div>{}</div>"
    rows = [(1, "http://a.b/x/1", page.format("left", 1, "one")), (2, "http://a.b/x/2", page.format("left", 2, "right")), (3, "http://a.b/x/3", page.format("three", 3, "right"))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "own 2\n\nright"


def test_html_line_inside_needs_most_pages_of_the_host(spark):
    page = "<body><div>{0}</div><article><h2>same heading</h2><p>a text of its own, which is long enough to outweigh what is shared with others {0}</p>{1}<p>all rights reserved</p>{2}</article></body>"
    rows = [(i, f"http://a.b/{i:02}", page.format(i, "<p>a quoted passage</p>" if i in (2, 3) else "", "<p>a last line</p>" if i == 5 else "")) for i in range(10)]
    rows += [(20 + i, f"http://few.pages/{i}", page.format(i, "", "")) for i in range(7)]
    recipe = "<article><p>take {0} eggs, and what else is there in the kitchen on day {0}<p>Serve warm.</article>"
    rows += [(40 + i, f"http://food.org/{i}", recipe.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("rights" not in got[i] and "same heading" in got[i] for i in range(10)) and "quoted" in got[2] and "quoted" in got[3] and "a last line" in got[5]
    assert all("rights" in got[20 + i] for i in range(7)) and all(got[40 + i].endswith("Serve warm.") for i in range(3))


# personal data


def spans(text, row):
    return {(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in row.spans.split(",") if x)}


def test_found_by_context(spark):
    """Planted identifiers that no base pattern takes, behind contexts that seeds have induced, and decoys of the same shapes elsewhere."""
    rnd, rows, want = random.Random(1), [], {}
    number = lambda: f"{rnd.randint(200, 999)}-{rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}"
    code = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    for i in range(60):
        rows.append((len(rows), f"{prose(rnd, 20)} reach me on +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} {prose(rnd, 9)} token = \"{code(40)}\" {prose(rnd, 5)} mail: x{i}@example{i}.com or {prose(rnd, 4)}"))
    for _ in range(40):
        hidden = {"phone": number(), "secret": code(10), "email": f"jörg{rnd.randint(1, 999)}@münchen{rnd.randint(1, 999)}.de"}
        want[len(rows)] = {(k, v) for k, v in hidden.items()}
        rows.append((len(rows), f"{prose(rnd, 20)} reach me on {hidden['phone']} {prose(rnd, 9)} token = \"{hidden['secret']}\" {prose(rnd, 7)} mail: {hidden['email']} or {prose(rnd, 5)}"))
    for _ in range(60):  # the same shapes behind other words
        rows.append((len(rows), f"{prose(rnd, 20)} part number {number()} {prose(rnd, 9)} commit {code(10)} {prose(rnd, 7)}"))
    got = {r.doc_id: r for r in private_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(len(want[i] & spans(rows[i][1], got[i])) for i in want)
    added = sum(r.n_added for r in got.values())
    seeds = 60  # the long tokens
    assert hit == sum(map(len, want.values())) and added == hit + seeds, (hit, added)


def test_identifiers_of_any_length(spark):
    rows = [(i, f"write to the desk: bob{i}@host{i}.example.com today") for i in range(12)] + [(20, f"write to the desk: {'y' * 70}@host today"), (21, "write to the desk: ann@host today"), (22, f"{'w' * 5000} desk: cy@host today"), (23, f"{'w' * 5000}: di@host today")]
    got = {r.doc_id: r for r in private_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans(rows[12][1], got[20]) == {("email", "y" * 70 + "@host")} and spans(rows[13][1], got[21]) == {("email", "ann@host")}
    assert got[22].n_added == 1 and got[23].n_added == 0  # "today" follows all, which alone says nothing


@pytest.mark.parametrize("n", [127, 128, 129, 12_000])
def test_text_of_many_matches(spark, n):
    """Places of matches within and beyond a block, and candidates beside base spans."""
    parts = [(f"é x{i} ", f"10.{i % 256}.0.{i % 200}" if i % 3 else f"a{i}@b.co", f" or 123-45-{i:06} end.\n") for i in range(n)]
    at, base = 0, {"email": [], "ip": []}
    for i, (a, m, b) in enumerate(parts):
        kind = "ip" if i % 3 else "email"
        base[kind].append(f"{kind}:{at + len(a)}:{at + len(a) + len(m)}")
        at += len(a) + len(m) + len(b)
    (r,) = private_data.found_by_pattern(spark.createDataFrame([(1, "".join(map("".join, parts)))], "doc_id long, text string")).withColumn("open", F.expr("size(filter(seen, x -> not x.base))")).drop("seen").collect()
    assert (r.n_email, r.n_ip, r.open) == (len(base["email"]), len(base["ip"]), n)
    assert r.base_sha256 == hashlib.sha256(",".join(base["email"] + base["ip"]).encode()).hexdigest()


def test_scores_against_plain_rounds(spark):
    rnd = random.Random(3)
    seen = [(rnd.choice((None, None, 0, 1, 3)), rnd.choice((0, 1, 2, 3, 9, 11)), i % 45, [(p % 3, p) for p in rnd.sample(range(14), 3)]) for i in range(160)]
    seen = [(k, m if k is None else 1 << k, i, p) for k, m, i, p in seen]
    frame_ = spark.createDataFrame([(k, m, i, [{"side": s, "id": p} for s, p in ps]) for k, m, i, ps in seen], "kind int, may int, instance long, patterns array<struct<side:int,id:long>>")
    known, sure = private_data.scored(frame_, common.Scratch(spark, "test"))
    pairs = collections.defaultdict(int)
    for _, m, i, ps in seen:
        for _, p in ps:
            pairs[p, i] |= m
    of = collections.defaultdict(list)
    for (p, i), m in pairs.items():
        of[p].append((i, m))
    seeds = {(i, k): 1.0 for k, _, i, _ in seen if k is not None}
    seeded = {i for i, _ in seeds}
    now = seeds
    for _ in range(private_data.ROUNDS):
        confidence = {}
        for p, rows in of.items():
            for kind in {k for i, _ in rows for j, k in now if j == i} if len(rows) >= private_data.LEAST else ():
                x = sum(now.get((i, kind), 0.0) for i, _ in rows)
                can = sum(m >> kind & 1 for _, m in rows)
                n = x + len(rows) - can + 0.5 * max(can - x, 0)
                z, q = private_data.Z2, x / n
                low = (q + z / (2 * n) - math.sqrt(z * (q * (1 - q) / n + z / (4 * n * n)))) / (1 + z / n)
                if low >= private_data.SURE:
                    confidence[p, kind] = low
        best = collections.defaultdict(lambda: [0.0] * 3)
        for (p, i), m in pairs.items():
            for kind in range(5):
                if i not in seeded and m >> kind & 1 and (p, kind) in confidence:
                    best[i, kind][p % 3] = max(best[i, kind][p % 3], confidence[p, kind])
            now = seeds | {key: max(c[2], 1 - (1 - c[0]) * (1 - c[1]) if c[0] else 0.0) for key, c in best.items()}
    got = {(r.instance, r.kind): r.score for r in known.collect()}
    assert got.keys() == now.keys() and all(abs(got[k] - now[k]) < 1e-9 for k in now)
    assert {(r.pattern, r.kind) for r in sure.collect()} == set(confidence)


# token ids


def test_best_fit_against_plain():
    rnd = random.Random(7)
    for _ in range(50):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 60))]
        room, want = [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in room if r >= lengths[k]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - lengths[k])
            else:
                room.append(40 - lengths[k])
            want.append(sorted(room))
        bins = token_output.best_fit_decreasing(lengths, 40)
        assert sorted(40 - sum(lengths[k] for k in b) for b in bins) == sorted(room) and sorted(k for b in bins for k in b) == list(range(len(lengths)))


def test_written_matrices(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, prose(rnd, rnd.choice((0, 3, 200, 5000)))) for i in range(40)] + [(None, "null id"), (3, prose(rnd, 9))]
    token_output.write_packed(frame(spark, rows), f"{tmp_path}/packed")
    total, seen = 0, set()
    for r in pq.read_table(f"{tmp_path}/packed").to_pylist():
        ids, at = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cuts = r["cu_seqlens"]
        assert len(ids) == len(at) == 2048 and cuts[0] == 0 and cuts[-1] == r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(ids[: r["n_tokens"]].astype("<u4").tobytes()) and not ids[r["n_tokens"] :].any()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            assert (at[lo:hi] == np.arange(hi - lo)).all()
        total += r["n_tokens"]
        seen.add(r["sequence_id"])
        assert len(r["doc_ids"]) == len(r["starts"]) == len(cuts) - 1
    words = tokens.WordIds(tokens.default_path())
    import pyarrow as pa

    assert total == sum(map(len, words.all_ids(pa.array([t for _, t in rows])))) and len(seen) > 1
    assert token_output.id_type({"a": 65_535}) == "<u2" and token_output.id_type({"a": 65_536}) == "<u4"


@pytest.mark.parametrize("n", [0, 1])
def test_no_and_one_row(spark, n):
    docs = frame(spark, [(1, None)][:n])
    for f in (near_dup.without_near_copies, exact_dup.without_copies):
        assert f(docs).count() == n
    assert mixing.mix(docs).count() == 0 and private_data.personal_data(docs).count() == n
    assert hashlib.sha256(b"").hexdigest() in {r.base_sha256 for r in private_data.personal_data(docs).collect()} or not n
