"""The stages of the pipeline, each against a plain version on the rows that its predecessor kept."""

import re

import corpus_pipeline
from tests.llm.test_operators import shingles


def test_stages_on_whole_documents(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    known, exact, near, mixed, packed = kept

    plain = {}
    for r in known:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        plain[key] = min(plain.get(key, r), r, key=lambda r: (-len(r.text), r.doc_id))
    assert {r.doc_id for r in exact} == {r.doc_id for r in plain.values()}

    sets, root = {r.doc_id: shingles(r.text, 5) for r in exact}, {r.doc_id: r.doc_id for r in exact}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id for r in near} == {i for i in root if root[i] == i}

    whole = {r.doc_id: len(r.text.split()) for r in near}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert taken.keys() <= whole.keys() and all(taken[i] <= 2 * whole[i] for i in taken)

    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, and columns named as those that the stages use."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, words, None, None, None, 7), (1, words, None, None, None, 7), (None, words + " x", None, "s", 1, 7), (2, None, "en", "s", 1, 7), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        # 6 of 7 shingles are shared: a near copy, which goes even without a doc_id (rows without one were once never removed)
        assert (1, words) in got and ((None, words + " x") in got) == (stage is not corpus_pipeline.near_copies) and len(got) <= 2 * len(rows)
        assert corpus_pipeline.STAGES[4][1](spark, out, "").count() >= len(got)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, "").columns == docs.columns
