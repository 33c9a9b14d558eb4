"""Borderline near copies, functions on executors without the package, and the operators of the third round against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.llm import common, exact_dup, fill_middle, html_text, language, merkle, near_dup, private_data, quality, suffix_tree
from tests.llm.test_operators import shingles
from tests.llm.test_round2 import DOCS, WORDS, components_of, frame, prose


def test_borderline_families(spark):
    """400 families of a text, a copy with 5 of its 150 words changed and one with 4: their similarities lie about the threshold."""
    rnd, rows, want = random.Random(12), [], []
    vocabulary = [a + b + c for a in WORDS for b in ("ba", "ke", "li") for c in ("", "n", "s")]
    for f in range(400):
        base = [rnd.choice(vocabulary) for _ in range(150)]
        family = []
        for changes in (5, 4, 4):
            own = list(base)
            for k in rnd.sample(range(150), changes):
                own[k] = rnd.choice(vocabulary)
            family.append(" ".join(own))
        rows += [(3 * f + k, t) for k, t in enumerate(family)]
        root = components_of(family, 2)
        least = {r: min(k for k in range(3) if root[k] == r) for r in root}
        want += [(3 * f + k, 3 * f + least[root[k]]) for k in range(3)]
    got = near_dup.near_duplicates(frame(spark, rows), 2, 80).collect()
    linked = sum(a != b for a, b in want)
    assert 100 < linked < 750  # some families hold together, some do not
    assert sorted((r.doc_id, r.component_id) for r in got) == want


def test_bits_are_counted_unsigned():
    rng = np.random.default_rng(8)
    pairs = []
    for _ in range(800):
        x = rng.integers(0, 2**63, 400, dtype=np.uint64)
        y = x.copy()
        y[:45] = rng.integers(0, 2**63, 45, dtype=np.uint64)  # 355 of 445: just below 0.8
        pairs += [np.unique(x), np.unique(y)]
    bits = near_dup.two_bits(near_dup.sketch(pairs))
    assert (bits < 0).any()
    plain = [sum((int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else ((int(a) ^ int(b)) + 2**64).bit_count() for a, b in zip(p, q, strict=True)) for p, q in zip(bits[::2], bits[1::2], strict=True)]
    told = np.bitwise_count((bits[::2] ^ bits[1::2]).view(np.uint64)).sum(1)
    assert told.tolist() == plain and max(plain) <= near_dup.MAX_BITS - 10


def test_functions_travel_without_the_package(tmp_path):
    """What executors run is read in a process that cannot import the package."""
    given = [near_dup._sketcher(5), near_dup._setter(5), near_dup._bit_checker(80), near_dup._set_checker(80), near_dup._star_checker(80), html_text._extract, language._predictor({"en": b"x"}, language._predictions), fill_middle._transformer(7, 100, 50)]
    given += [merkle._up, merkle._down(True), suffix_tree._counter(None), suffix_tree._scorer(None), suffix_tree._asker(8), suffix_tree._owner(5), suffix_tree._adder]
    for k, f in enumerate(given):
        (tmp_path / str(k)).write_bytes(cloudpickle.dumps(common.gives_back(f)))
    code = "import pickle,sys\nfor p in sys.argv[1:]: pickle.load(open(p,'rb'))\nassert 'tessera' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code, *map(str, sorted(tmp_path.iterdir()))], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-600:]


# fill in the middle


def plain_fill(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = [None, "", "\n", "\n\n\n", "one", "one\ntwo", "a\r\nb\u2028c\x85d\x0be\n\nf", "holds <P> a marker\nx", "<S", "<<\n>P>\n<", "\u00e9\u6f22\n" * 50, "x" * 300_000 + "\n" + "y\n" * 40_000]


@pytest.mark.parametrize("percent", [100, 40])
def test_fill_in_middle(spark, percent):
    rows = [(i if i != 7 * len(ODD) else None, ODD[i % len(ODD)], 1, "x") for i in range(8 * len(ODD))] + [(3, "again\nand\nagain", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, output string")
    out = fill_middle.fill_in_middle(docs, percent=percent).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(x if x is not None else -1 for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted(((i, *plain_fill(i, t, percent)) for i, t, _, _ in rows), key=key)
    assert collections.Counter(r.back for r in out) == collections.Counter(t or "" for _, t, _, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


# Merkle manifest


def plain_tree(leaves):
    """The root and, for each leaf, its levels of siblings before and behind."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        cut = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, p in enumerate(at):
            paths[i].append(("".join(cut[p // 16][: p % 16]), "".join(cut[p // 16][p % 16 + 1 :])))
        nodes, at = [hashlib.sha256("".join(c).encode()).hexdigest() for c in cut], [p // 16 for p in at]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(*values):
        return hashlib.sha256(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values)).hexdigest()

    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], leaf(*r), leaf(*r[:4], low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([x[1] for x in by[s]]))
    root, outer = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), above in zip(order, trees, outer, strict=True):
        for (doc_id, own, forged), path in zip(by[s], paths, strict=True):
            node = forged or own
            for before, behind in path + above:
                node = hashlib.sha256((before + node + behind).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in path + above).encode()).hexdigest()
            out.append((doc_id, own, subroot, root, proof, node, node == root))
    return out


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"
KEY = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17, 1, 1), (300, 256, 257, 3), (4097,), (1,) * 40, (0,)])
def test_manifest(spark, sizes):
    rnd, rows = random.Random(len(sizes)), []
    for k, n in enumerate(sizes):
        for i in range(n):
            rows.append((rnd.randrange(3 * n), None if not k else f"s\u00e9{k}" if k % 2 else f"S{k}", rnd.choice(["en", None]), rnd.choice([None, 7]), rnd.choice([None, "", "Ab", "ab", f"X{i}", "\u00c9\u00e9 ab"])))
    rows += rows[:3] + [(None, *r[1:]) for r in rows[:2]]  # repeated rows, rows without doc_id
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], MERKLE + ", pos long, digest string")
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=KEY) == sorted(plain_manifest(rows), key=KEY) if rows else got == []


def test_manifest_in_several_rounds(spark, monkeypatch):
    """Buckets of 16 nodes, so that a tree takes several rounds; sources joined as if they were too many to broadcast."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BUCKET", 16)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, f"s{i % 40}" if i % 3 else None, "en", i, f"Text {i}") for i in range(900)]
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, MERKLE)).collect()]
    assert sorted(got) == sorted(plain_manifest(rows))


# language model


def plain_scores(rows, least, share):
    """Of (doc_id, learns, text): n_tokens, n_known, N, base, score by dictionaries of token tuples."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for _, _, t in rows]
    learned = [t for (_, learns, _), t in zip(rows, tokens, strict=True) if learns]
    c = collections.Counter(w for t in learned for w in t)
    total, kinds = sum(c.values()), len(c)
    bound = max(least, -(-total // share))
    root = lambda w: (c[w] + 1) / (total + kinds + 1)
    usual = {w for w in c if c[w] >= bound}
    grams = collections.Counter()
    for t in learned:
        s = ["^", *t]
        for i in range(1, len(s)):
            for k in range(1, suffix_tree.DEPTH + 1):
                if i - k >= 0 and all(x in usual or x == "^" for x in s[i - k : i + 1]):
                    grams[tuple(s[i - k : i + 1])] += 1
    grams = {g: n for g, n in grams.items() if n >= bound}
    after = collections.defaultdict(dict)
    for g, n in grams.items():
        after[g[:-1]][g[-1]] = n
    seen = lambda s: (len(learned) if s == ("^",) else c[s[0]]) if len(s) == 1 else grams[s]
    p = {s: {w: n / (seen(s) + 1) for w, n in of.items()} for s, of in after.items()}
    up = lambda s, w: p[s[1:]][w] if len(s) > 1 else root(w)
    left = {s: ((1 - sum(of.values())), max(1 - sum(up(s, w) for w in of), 1e-12)) for s, of in p.items()}
    kept = set()
    for s, of in p.items():
        gain = seen(s) * (sum(x * math.log(x / up(s, w)) for w, x in of.items()) + left[s][0] * math.log(left[s][0] / left[s][1]))
        if gain > len(of) * math.log(max(seen(s), 2)) / 2:
            kept |= {s[k:] for k in range(len(s))}

    def share_of(s, w):
        if not s:
            return root(w)
        if s not in kept:
            return share_of(s[1:], w)
        return p[s][w] if w in p[s] else left[s][0] / left[s][1] * share_of(s[1:], w)

    out = []
    for (i, _, _), t in zip(rows, tokens, strict=True):
        s = ["^", *t]
        score = sum(math.log10(share_of(tuple(s[max(0, k - suffix_tree.DEPTH) : k]), s[k])) for k in range(1, len(s)))
        out.append((i, len(t), sum(w in c for w in t), total, sum(math.log10(root(w)) for w in t), score))
    sums = [sum(share_of(s, w) for w in c) + share_of(s, "unknown word") for s in list(kept)[:20]]
    return out, sums, len(kept), sum(len(s) == 2 for s in kept)


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, monkeypatch, small):
    if small:  # chunks of few tokens, texts in pieces, held windows sent early
        for name, n in (("TOKENS", 300), ("PIECE", 40), ("HELD", 50), ("_WORDS_KEPT", 20)):
            monkeypatch.setattr(suffix_tree, name, n)
    rnd = random.Random(6)
    phrases = [" ".join(rnd.choice(WORDS[:40]) for _ in range(5)) for _ in range(6)]
    rows = [(i, i % 7 != 2, " ".join(rnd.choice([*phrases, rnd.choice(WORDS), f"Rare{rnd.randrange(400)}"]) for _ in range(rnd.randrange(1, 60)))) for i in range(120)]
    rows += [(500, True, None), (501, True, ""), (502, False, " \n\x0b"), (3, True, rows[3][2]), (None, True, "phrase"), (503, False, "\u00c9\u6f22 " * 30)]
    docs = spark.createDataFrame([(i, t, k, 1) for i, k, t in rows], "doc_id long, text string, learns boolean, chunk long").repartition(3)
    got = suffix_tree.scores(docs, F.col("learns"), least=4, share=1 << 18).collect()
    want, sums, kept, deep = plain_scores(rows, 4, 1 << 18)
    assert kept > 10 and deep > 3 and all(abs(x - 1) < 1e-9 for x in sums)
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-9) and r.score == pytest.approx(w[5], abs=1e-9)
    held = [r for r in got if not r.learned and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_windows_count_however_many_tokens_there_are(spark):
    """what counts as a window was bounded by a share of all tokens, so here only what occurs 8 times did."""
    rows = [(i, True, "x " * 100_000) for i in range(20)] + [(100 + i, i < 6, f"alpha beta gamma d{i}") for i in range(8)]
    docs = spark.createDataFrame([(i, t, k) for i, k, t in rows], "doc_id long, text string, learns boolean").repartition(3)
    got = suffix_tree.scores(docs, F.col("learns")).orderBy("doc_id").collect()
    want, _, _, deep = plain_scores(rows, suffix_tree.LEAST, 1 << 60)
    assert deep > 0
    for r, w in zip(got[20:], want[20:], strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-9) and r.score == pytest.approx(w[5], abs=1e-9)
    assert all(r.score > r.base_score + 5 for r in got[26:])


@pytest.mark.parametrize("least", [1, 2])
def test_scores_of_rare_windows(spark, least):
    """every window can be an entry, those that occur once, too."""
    rnd = random.Random(least)
    rows = [(i, i % 7 != 2, " ".join(f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randrange(40)))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, k) for i, k, t in rows], "doc_id long, text string, learns boolean").repartition(5)
    got = suffix_tree.scores(docs, F.col("learns"), least=least).orderBy("doc_id").collect()
    want, sums, kept, deep = plain_scores(rows, least, 1 << 60)
    assert kept > 50 and deep > 20 and all(abs(x - 1) < 1e-9 for x in sums)
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-9) and r.score == pytest.approx(w[5], abs=1e-9)


def test_scores_without_texts_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_tree.scores(docs, F.lit(False)).collect()) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert suffix_tree.scores(docs.limit(0), F.lit(True)).count() == 0


# html


def test_html_names_inside_an_article():
    for page, want in (
        ("<article class='post comment-text'><p>a</article>", ["a"]),
        ("<article><h2 class=header>title</h2><p>a</article>", ["title", "a"]),
        ("<article><header><h1>title</h1><p>by someone</header><p>a</article>", ["title", "by someone", "a"]),
        ("<article><header><a href=x>home page</a> <a href=y>news</a></header><p>a</article>", ["a"]),
        ("<article><p>a<div class=social>what people do with each other</div></article>", ["a", "what people do with each other"]),
        ("<article><p>a<div class=social><a href=x>tell a friend</a></div></article>", ["a"]),
        ("<article><ul class=menu><li>soup<li>fish with rice</ul></article>", ["soup", "fish with rice"]),
        ("<article><ul class=menu><li><a href=a>home</a><li><a href=b>contact</a></ul><p>a</article>", ["a"]),
        ("<article><p>a<div class=footer><input name=q><input name=r> go</div></article>", ["a"]),
        ("<article><p>a<div class=comments><p>a reader's words, without a link</div><div class='ad'>buy</div></article>", ["a"]),
        ("<header><h1>site</h1></header><div class=menu>x</div><article><p>a</article>", ["a"]),
        ("<article><b><span class=menu>soup</b></span><p>a</article>", ["soup", "a"]),
    ):
        assert html_text.lines(page)[0] == want, page


def plain_main_text(rows):
    """page_id -> text by going through all pages of a host in order; the alignment itself is tested elsewhere."""
    split = lambda u: re.fullmatch(r"http://([^/]*)(.*)", u).groups()
    out = {i: "" for i, _, _ in rows}
    by = {}
    for i, u, h in rows:
        page = html_text.lines(h)
        if page[0]:
            by.setdefault(split(u)[0], []).append((split(u)[1], i, page))
    for pages in by.values():
        different = {repr(p) for _, _, p in pages}
        ends = collections.Counter()
        for p in [p for k, (_, _, p) in enumerate(pages) if all(q != p for _, _, q in pages[:k])]:
            own = [x for x, w in zip(*p, strict=True) if w == 1]
            ends.update({("^", x) for x in own[: html_text.EDGES]} | {("$", x) for x in own[-html_text.EDGES :]})
        articles = sum(any(w == 1 for w in eval(p)[1]) for p in different)
        fixed = {x for x, n in ends.items() if n >= html_text.PAGES and 2 * n > articles}
        pages.sort(key=lambda p: (p[0], p[1]))
        for k, (path, i, page) in enumerate(pages):
            near = []
            for step in (-1, 1):
                j = k
                while 0 <= j < len(pages) and pages[j][2] == page:
                    j += step
                if 0 <= j < len(pages):
                    near.append(pages[j])
            text, inside = page
            size = lambda p, of=None: sum(len(x) for j, (x, w) in enumerate(zip(*p, strict=True)) if w and (of is None or j in of))
            if not near:
                out[i] = "\n\n".join(x for x, w in zip(text, inside, strict=True) if w or 2 * size(page) < sum(map(len, text)))
                continue
            common = [len([1 for a, b in itertools.takewhile(lambda z: z[0] == z[1], zip(path, n[0], strict=False))]) for n in near]
            other = near[common.index(max(common))][2]
            gone = html_text.shared(text, other[0])
            copies = size(page) and 2 * size(page, gone) >= min(size(page), size(other) or size(page))
            own = [j for j, w in enumerate(inside) if w == 1]
            ends = {j for j in own[: html_text.EDGES] if ("^", text[j]) in fixed} | {j for j in own[-html_text.EDGES :] if ("$", text[j]) in fixed}
            gone = {j for j in gone if not inside[j] or not copies and j in ends}
            out[i] = "\n\n".join(text if len(gone) == len(text) else [x for j, x in enumerate(text) if j not in gone])
    return out


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_html_against_a_plain_version(spark, partitions):
    rnd, rows = random.Random(3), []
    for i in range(160):
        site = rnd.randrange(6)
        own = "".join(f"<p>{rnd.choice(['line', 'passage'])} {rnd.randrange(200)} of the text, with more words than the rest" for _ in range(rnd.randrange(0, 6)))
        page, *_ = rnd.choices([f"<div>site {site}</div><article><p>Filed {site}<h2>head {rnd.randrange(3)}</h2>{own}<p>rights {site}</article><div>end</div>", f"<div>site {site}</div>{own}<p>end", "", f"<article>{own}</article>", f"<div>site {site}</div><article>{own}<p>rights {site}</article>"], (8, 1, 1, 1, 1))
        rows.append((i, f"http://h{site}.org/{rnd.choice('ab')}/{rnd.randrange(40)}", page if rnd.random() < 0.9 else rows[-1][2] if rows else page))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_main_text(rows)
    assert got == want
    assert sum("Filed" in h and "Filed" not in want[i] for i, _, h in rows) > 10  # some lines inside go, by the host's pages


def test_html_of_the_given_pages(spark):
    """Every line of every article is kept, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        text, inside = html_text.lines(r.html)
        assert got[r.page_id] == "\n\n".join(x for x, w in zip(text, inside, strict=True) if w)


# quality, language


def test_prose_of_a_language_without_a_list(spark):
    """Italian prose passes, a list of different words does not, be it of that length or longer."""
    text = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era \u00e8 cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura tant \u00e8 amara che poco \u00e8 pi\u00f9 morte ma per trattar del ben ch i vi trovai dir\u00f2 de l altre cose ch i v ho scorte io non so ben ridir com i v intrai tant era pien di sonno"
    rows = [(1, text), (2, " ".join(f"code{i}x" for i in range(160))), (3, " ".join(f"code{i}x" for i in range(59)))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(frame(spark, rows)).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, True)}


def test_too_many_languages_are_an_error(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="100000 different values"):
        language.fit(docs)
    assert len(language.fit(docs.where("doc_id < 600"))) == 600


def test_a_component_of_many_classes(spark, monkeypatch):
    """A chain of texts, each a class of its own and alike to the next only, over joins that deal out keys of more than four rows."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 120])) for i in range(50)]
    got = near_dup.near_duplicates(frame(spark, rows), 2, 80).collect()
    assert {(r.component_id, r.kept == (r.doc_id == 0)) for r in got} == {(0, True)}


# personal data, planted in the given documents


def planted(docs, every=25):
    """Rows of docs (doc_id, text) with an identifier and its context put in at a place of their own: seeds of base patterns, ones of the same kinds that no base pattern takes, and
    strings of these shapes behind words that no seed stands behind. And what is to be found of each document."""
    rnd, rows, want = random.Random(14), [], {}
    number = lambda: f"{rnd.randint(200, 999)}-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
    code = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    for i, (doc_id, text) in enumerate(docs):
        words = (text or "").split(" ")
        found, part = {}, ""
        if i % every in (1, 4):  # two seeds for each hidden one
            part = f"reach our desk on +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} any day. Our token = \"{code(40)}\" holds. Write to the office at box{i}@mail{i}.com or come."
        elif i % every == 2:
            found = {"phone": number(), "secret": code(10), "email": f"jörg{i}@münchen{i}.de"}
            part = f"reach our desk on {found['phone']} any day. Our token = \"{found['secret']}\" holds. Write to the office at {found['email']} or come."
        elif i % every == 3:
            part = f"part number {number()} fits. Commit {code(10)} broke. Version x{rnd.randint(1, 9)}@{rnd.randint(1, 99)} fell."
        at = rnd.randrange(len(words) + 1)
        text = " ".join([*words[:at], part, *words[at:]]) if part else text
        want[doc_id] = {(k, text.index(v), text.index(v) + len(v)) for k, v in found.items()}
        rows.append((doc_id, text))
    return rows, want


def test_private_data_planted_in_documents(spark):
    """Of what was planted, all is found; of the spans that are added, none is at a decoy. (README has the figures of larger tables.)"""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rows, want = planted(docs)
    before = {r.doc_id: set(r.spans.split(",")) for r in private_data.personal_data(frame(spark, docs)).collect()}
    got = {r.doc_id: r for r in private_data.personal_data(frame(spark, rows)).collect()}
    spans = {i: {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} for i, r in got.items()}
    hit = sum(len(w & spans[i]) for i, w in want.items())
    text, decoys = dict(rows), 0
    for i, (doc_id, _) in enumerate(docs):
        if i % 25 == 3:
            decoys += len(got[doc_id].spans.split(",")) - len(before[doc_id]) if got[doc_id].spans else 0
    assert hit >= 0.95 * sum(map(len, want.values())) and decoys == 0, (hit, sum(map(len, want.values())), decoys, len(text))
