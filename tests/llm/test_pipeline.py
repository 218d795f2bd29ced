"""The stages one by one on the given tables, and on rows that are odd in every way."""

import corpus_pipeline
from foliospark.llm import pii, queries

from .test_decontaminate import brute as overlaps
from .test_jaccard import brute as components

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "tokens":
            assert docs.columns == columns
        if name == "toxicity":  # hardly a toxic label in so few rows; see the next test
            assert len(after) > 0.9 * len(before)
        if name == "near_duplicates":
            want = {k for k, _, c in components(list(before.items())) if k == c}
            assert set(after) == want and len(want) < len(before)
        if name == "decontamination":
            assert set(before) - set(after) == {i for i, _ in overlaps(list(before.items()), bench)}
        if name == "personal_data":
            assert set(after) == set(before)
            assert not any(pii.base_spans(r.text) for r in after.values())
        if name == "tokens":
            assert set(after) == set(before) and all(r.exact and r.n_tokens == len(r.ids) for r in after.values())


def test_toxic_documents_go(spark):
    d = "/root/testdata/sf0.01"
    docs = queries.table(spark, d, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, d).collect()}
    scored = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, d).collect()}
    assert kept == {k for k, p in scored.items() if p == 0} and 0 < len(scored) - len(kept) < 150


def test_odd_rows(spark):
    words = "some few words that make a text of their own here"
    rows = [
        (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
        (3, words, "en", "s", 5), (3, words, "en", "s", 5), (None, words, "en", "s", 5), (4, words + " too", "en", "s", 6),
        (5, "word " * 60_000, None, "s", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema + ", set string")
    for name, stage in corpus_pipeline.STAGES:
        # The near-copy stage over an empty table is in its own tests.
        for table in (docs,) if name == "near_duplicates" else (docs, docs.limit(0)):
            got = stage(spark, table, SF_DIR)
            n = got.count()
            if table is not docs:
                assert n == 0
            elif name == "near_duplicates":
                assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "2", "3", "5", "None", "None"]
            else:
                assert n == len(rows), name
            if name != "tokens":
                assert got.columns == docs.columns


def test_run_hands_each_stage_what_the_one_before_kept(spark, monkeypatch):
    seen = []

    def stage(low):
        def keep(spark, docs, sf_dir):
            seen.append(docs.count())
            return docs.filter(f"doc_id >= {low}")

        return keep

    stages = [("first", stage(50)), ("second", stage(120)), corpus_pipeline.STAGES[-1]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids", "exact"]
    rows = got.collect()
    assert seen == [200, 150] and len(rows) == 80 and all(r.exact for r in rows)
