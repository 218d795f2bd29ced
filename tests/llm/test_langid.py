"""Language profiles: the vectors against a letter-by-letter version, and held-out accuracy."""

import numpy as np

from foliospark.llm import langid, queries

SF_DIR = "/root/testdata/sf0.01"


def slow_bundle(text):
    letters, table = langid.letter_vectors().astype(int), langid.alphabet()
    total = np.zeros(langid.DIMENSION)
    spaced = [0] + [int(table[ord(c)]) for c in text] + [0]
    collapsed = [c for i, c in enumerate(spaced) if c or i == 0 or spaced[i - 1]]
    collapsed += [0]
    for a, b, c in zip(collapsed, collapsed[1:], collapsed[2:]):
        if b:
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_bundles():
    texts = ["The cat, sat!", "", "é è ñandú", "a", "12 34", "Zß  \n x"]
    got = langid.bundle(texts, langid.alphabet(), langid.letter_vectors())
    for row, text in zip(got, texts):
        assert np.allclose(row, slow_bundle(text)), text


def test_held_out(spark):
    got = queries.op2_language(spark, SF_DIR)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string"
    rows = [
        (1, "the cat and the dog", "en", "x", "x"), (2, "der hund und die katze", "de", "x", "x"),
        (3, None, "de", "x", "x"), (4, "", "en", "x", "x"), (5, "123 !", None, "x", "x"),
        (None, "the dog", None, None, None), (1, "the cat and the dog", "en", "x", "x"),
        (6, "und die " * 50_000, None, "x", "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    model = langid.fit(df, "text", "lang")
    assert model[0] == ["de", "en"]
    got = langid.predict(df, "doc_id", "text", model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [
        (0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"),
    ]
    none = langid.fit(df.filter("false"), "text", "lang")
    assert none[0] == []
    got = langid.predict(df, "doc_id", "text", none).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.predict(df.limit(0), "doc_id", "text", model).count() == 0
