"""Personal data: base spans against the patterns as written, and spans carried over."""

import hashlib
import random
import re

from foliospark.llm import pii, queries

SF_DIR = "/root/testdata/sf0.01"


def plain(text):
    """The rules as they are stated, with backtracking patterns."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        double = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
        if 12 <= len(d) <= 19 and sum(sum(map(int, str(n))) for n in double) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_on_noise():
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choice("a1@.+- (25%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("@b.c@d.e", "a@b.c@d.e", "x@y@z.de", "1.2.3.4.5.6.7.8", "01.002.3.4", "+1 23"):
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for c in ("a", "1", "@", "1.", "+1(", "a@", "1-"):
        pii.spans_of([c * 200_000], pii.Model(_zero(), _flat()))


def _zero():
    import numpy as np

    return np.zeros((pii.FEATURES, pii.LABELS))


def _flat():
    import numpy as np

    return np.zeros((3, pii.LABELS, pii.LABELS))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op5_personal_data(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    total = 0
    for r in rows:
        want = plain(docs[r.doc_id])
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        counts = [sum(k == i for _, k, _ in want) for i in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(","))
        total += len(want)
    assert total > 50


def test_label_is_carried_to_a_similar_mention(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = pii.fit(docs, "doc_id", "text")
    far = " word" * 500
    rows = [
        (1, f"call +49 170 1234567 now{far} or 491701234567 again", "x"),
        (2, f"order 491701234567{far}", "x"),
        (3, None, "x"), (4, "", None), (4, "", None), (None, "a@b.cd", "x"),
        (5, "7 " * 100_000, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.find(df, "doc_id", "text", model).collect()}
    assert got[1] == [("phone", True), ("phone", False)]
    assert got[2] == got[3] == got[4] == got[5] == []
    assert got[None] == [("email", True)]
    out = {r.doc_id: r for r in pii.redact(df, "text", model).collect()}
    assert out[1].text == f"call [PHONE] now{far} or [PHONE] again"
    assert out[3].text is None and out[4].text == "" and out[1].spans == "x"
    none = pii.fit(df.limit(0), "doc_id", "text")
    got = {r.doc_id: len(r.spans) for r in pii.find(df, "doc_id", "text", none).collect()}
    assert got[1] in (1, 2) and got[2] == 0
    assert pii.find(df.limit(0), "doc_id", "text", model).count() == 0


def test_label_reaches_dozens_of_repeats(spark):
    model = pii.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text")
    for before, after in ((0, 1), (0, 60), (60, 0), (40, 40), (3, 2000)):
        for bare in ("then 491701234567 again ", "then 491701234567 costs 55512 of "):
            text = bare * before + "call +49 170 1234567 now " + bare * after + "or 5551 units"
            found = pii.spans_of([text, "order 491701234567 of " * 60], model)
            assert [(KIND_PHONE, i == before) for i in range(before + after + 1)] == [
                (k, base) for _, k, _, base in found[0]
            ]
            assert found[1] == []


def test_beliefs_do_not_depend_on_other_texts(spark):
    model = pii.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text")
    texts = ["call +49 170 1234567 or 491701234567 " * 5, "7 8 9 " * 50, "", "a@b.cd 17 a@b.cd"]
    together = pii.beliefs(pii.graph(texts), model)
    alone = [pii.beliefs(pii.graph([t]), model) for t in texts if t]
    assert sum(map(len, alone)) == len(together)
    assert (together == [p for own in alone for p in own]).all()


KIND_PHONE = pii.KINDS.index("phone")


def test_very_long_parts():
    """Parts of an address of more digits than Python reads as one number."""
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.2.3") == [(0, 1, 5006)]
    assert pii.base_spans(f"{zeros}9999.1.2.3") == [] and pii.base_spans("1" * 9000 + ".1.2.3") == []
