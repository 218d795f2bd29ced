"""Spelling variants against the definition, word by word."""

import random
import re
import zlib
from collections import Counter

import pytest
from oracle import connect, difference

from foliospark.llm import queries, variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(counts, times=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(
        (w, n, len(near[w]), form[w] or "", counts[form[w]] if form[w] else 0, root(w)) for w, n in counts.items()
    )


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("block,letters", [(16_384, "ab"), (7, "abé"), (16_384, "abc\U0001f600中")])
def test_words(spark, monkeypatch, block, letters):
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    monkeypatch.setattr(variants, "READ_WORDS", 5)
    rng = random.Random(1)
    counts = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 200) for _ in range(400)}
    counts["a" * 700] = 5
    counts["a" * 350 + "b" + "a" * 350] = 50
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(variants.forms(df)) == brute(counts)


def test_ties_chains_and_empty(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "abbbc": 16, "zzzzz": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(variants.forms(df))
    assert got == brute(counts)
    assert ("aaaaa", 1, 1, "aaaab", 2, "abbbb") in got
    assert variants.forms(df.limit(0)).count() == 0


def test_vocabulary(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcÀÿ×xyzQ", k=rng.randint(3, 8))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=80)), "x") for i in range(120)]
    docs += [(500, None, "x"), (501, "", "x"), (None, "wordy Wordy wordy", "x"), (502, "Straße ÀÉabcĀabcde " * 3, "x"), docs[0]]
    want = Counter()
    for key, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    got = {r.word: r.n for r in variants.vocabulary(df, "doc_id", "text").collect()}
    assert got == want
    assert variants.vocabulary(df.limit(0), "doc_id", "text").count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op13_spelling_variants(spark, d).toPandas()
    assert difference(got, connect(d).execute(queries.SQL["op13_spelling_variants"]).df()) is None
