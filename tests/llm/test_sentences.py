"""Sentence runs against a loop over all texts."""

import random
import re

from foliospark.llm import queries, sentences

SF_DIR = "/root/testdata/sf0.01"


def brute(rows, least_sentences=2, least_words=15):
    """Texts in key order; runs of every length are looked up in a dictionary of their sentences.
    Of a longer run that was seen all shorter ones were too, so 60 sentences are long enough."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        spans = sentences.pieces(text or "")
        words = [tuple(re.findall(r"[^ \t\n\v\f\r]+", text[a:b])) for a, b in spans]
        total = [0]
        for w in words:
            total.append(total[-1] + len(w))
        off = set()
        for a in range(len(spans)):
            for b in range(a + least_sentences, min(len(spans), a + 60) + 1):
                if total[b] - total[a] >= least_words:
                    run = hash(tuple(words[a:b]))
                    if run in seen:
                        off.update(range(a, b))
                    seen.add(run)
        out[key] = (len(spans), len(off), text and "".join(text[a:b] for i, (a, b) in enumerate(spans) if i not in off))
    return out


def plain_pieces(text):
    """Pieces by the definition, word by word."""
    import numpy as np

    from foliospark.llm import shingles

    spans = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    if not spans:
        return [(0, len(text))] if text else []
    sums = []
    for a, b in spans:
        raw = np.frombuffer(text[a:b].encode(), np.uint8)
        sums.append(int(shingles.hashes_of(raw, np.array([0]), np.array([len(raw)]))[0]))
    cut = {0}
    sentence = [0]
    for i in range(1, len(spans)):
        if "\n" in text[spans[i - 1][1]: spans[i][0]] or text[spans[i - 1][1] - 1] in ".!?":
            cut.add(i)
        sentence.append(sentence[-1] + (i in cut))
    for i in range(len(spans) - sentences.WINDOW + 1):
        if sentence[i] == sentence[i + sentences.WINDOW - 1]:
            window = sums[i: i + sentences.WINDOW]
            cut.add(i + window.index(min(window)) + 1)
    at = [0] + [spans[i][0] for i in sorted(cut - {0}) if i < len(spans)] + [len(text)]
    return list(zip(at, at[1:]))


def test_pieces_by_definition():
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bé", "c.", "d!", " ", " ", " ", "\n", "\t ", "  \n\n", "\u00a0", "中"]) for _ in range(rng.randint(0, 120)))
        assert sentences.pieces(text) == plain_pieces(text)


def test_pieces():
    text = "One two. Three!\n\n  Four?? five. " + " ".join(f"w{i}" for i in range(100))
    spans = sentences.pieces(text)
    assert "".join(text[a:b] for a, b in spans) == text and len(spans) > 6
    long = " ".join(f"w{i}" for i in range(60))
    cuts = [long[a:b].strip() for a, b in sentences.pieces(long)]
    shifted = [s.strip() for t in ["x y " + long] for s in [t[a:b] for a, b in sentences.pieces(t)]]
    assert cuts[1:] == shifted[-len(cuts) + 1:]


def test_random_corpora(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) + "." for _ in range(12)]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, rows[5][1]), (102, ". " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:4]], "doc_id long, text string, n_removed string")
    got = sentences.dedup(df, "doc_id", "text").collect()
    want = brute(rows)
    assert len(got) == len(rows) + 4
    assert all((r.n_sentences, r.n_removed, r.text) == want[r.doc_id] for r in got)
    assert sum(r.n_removed for r in got) > 50
    assert sentences.dedup(df.limit(0), "doc_id", "text").count() == 0


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = brute(rows)
    got = queries.op1_sentence_runs(spark, SF_DIR).collect()
    assert len(got) == len(rows)
    assert all((r.n_sentences, r.n_removed, r.text) == want[r.doc_id] for r in got)
    assert sum(r.n_removed for r in got) > 100


def brute_all(rows, least_sentences=2, least_words=15):
    """As ``brute``, but runs of every length are looked up."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        spans = sentences.pieces(text)
        words = [tuple(text[a:b].split()) for a, b in spans]
        off = set()
        for a in range(len(spans)):
            for b in range(a + least_sentences, len(spans) + 1):
                if sum(map(len, words[a:b])) >= least_words:
                    run = tuple(words[a:b])
                    if run in seen:
                        off.update(range(a, b))
                    seen.add(run)
        out[key] = "".join(text[a:b] for i, (a, b) in enumerate(spans) if i not in off)
    return out


def test_repeated_stretch_goes_to_its_last_sentence(spark):
    def said(name, n):
        return " ".join(f"{name}{i}" for i in range(n)) + ". "

    stretch = said("a", 7) + said("b", 5) + said("c", 5)
    rows = [(1, stretch), (2, stretch), (3, said("x", 9) + stretch + said("y", 9))]
    rng = random.Random(7)
    pool = [said(c, rng.randint(1, 7)) for c in "abcdefghijkl"]
    rows += [(10 + i, "".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentences.dedup(df, "doc_id", "text").collect()}
    assert got[1] == stretch and got[2] == "" and got[3] == said("x", 9) + said("y", 9)
    assert got == brute_all(rows)


def test_passages_inside_other_sentences(spark):
    rng = random.Random(9)

    def said(n):
        return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))

    rows = []
    for i in range(150):
        passage = said(51)
        rows += [(2 * i, passage if i % 3 else f"{said(12)} {passage} {said(5)}.")]
        rows += [(2 * i + 1, f"{said(rng.randint(1, 30))} {passage} {said(rng.randint(0, 30))}.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentences.dedup(df, "doc_id", "text").collect()}
    assert all(got[i] == t for i, t in rows[::2])
    assert all(len(t.split()) - len(got[i].split()) >= 15 for i, t in rows[1::2])
