"""Shingle sets, signature trees and components against all pairs, and against SQL."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, difference

from foliospark.llm import components, jaccard, queries, shingles


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            root[find(i)] = find(keys.setdefault(k, i)) if sets[i] else find(i)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                c = len(sets[i] & sets[j])
                if 100 * c >= 75 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least[find(i)] if k is not None else None) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def test_sets():
    rng = random.Random(1)
    texts = [None, "", " ", "A b", "a b c d e", "a b c d e f A b c d e", "É é", "x" * 100 + " y z", "a\x0bb c"]
    texts += [" ".join(rng.choices(["a", "b", "Ab", "ß", "c\n"], k=rng.randint(0, 30))) for _ in range(400)]
    seen = {}
    for part in (texts, texts[:7], [t for t in texts if t and len(t) < 80]):
        h, starts = shingles.sets(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            mine = frozenset(h[starts[i] : starts[i + 1]].tolist())
            assert len(mine) == len(shingle_set(t))
            assert seen.setdefault(frozenset(shingle_set(t)), mine) == mine
    assert len(set(seen.values())) == len(seen)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 200):
        base = [set(rng.choice(3000, rng.integers(4, 60), replace=False).tolist()) for _ in range(n)]
        base = [s if rng.random() < 0.5 else base[0] | set(rng.choice(3000, 3).tolist()) for s in base]
        flags = np.zeros((n, jaccard.BITS), bool)
        for i, s in enumerate(base):
            flags[i, [x % jaccard.BITS for x in s]] = True
        part = rng.integers(0, n, n)
        cut = n // 2
        size = np.array([len(s) for s in base])
        bits = np.packbits(flags, axis=1)
        whole = jaccard.SignatureTree(np.arange(n), size, part, bits)
        got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in jaccard.candidates(whole, whole)))}
        want = {
            (i, j) for j in range(n) for i in range(j)
            if part[i] != part[j] and 4 * len(base[i] & base[j]) >= 3 * len(base[i] | base[j])
        }
        assert want <= got and all(part[i] != part[j] for i, j in got)
        if cut:
            x, y = (jaccard.SignatureTree(np.arange(n)[m], size[m], part[m], bits[m]) for m in (slice(0, cut), slice(cut, n)))
            got = set(zip(*(v.tolist() for v in jaccard.candidates(x, y))))
            assert {(i, j) for i, j in want if i < cut <= j} <= got


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 3), (2, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 8)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 20: 8, 21: 8, 22: 8, 23: 8, 24: 8}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [4_096, 3])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = []
    common = [f"c{i}" for i in range(12)]
    for g in range(25):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 60))]
        if g % 3 == 0:
            w += common
        for _ in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                v[rng.randrange(len(v))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), (" " if g % 2 else "\n").join(v)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "W1"), (904, "w1"), (None, rows[0][1]), (905, rows[0][1].upper())]
    rows += [(0, rows[0][1]), (1, "quite another text of some words here"), (906, "a b c d e " * 20_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = jaccard.linked(df, "doc_id", "text").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(brute(rows), key=order)
    assert jaccard.linked(df.limit(0), "doc_id", "text").count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op10_shingle_join(spark, d).toPandas()
    assert difference(got, connect(d).execute(queries.SQL["op10_shingle_join"]).df()) is None
    assert (got.component_id < got.doc_id).any()


def test_frequent_shingles_are_counted_once_a_set(spark, monkeypatch):
    """Copies do not count, on whichever task they are; the counts are exact."""
    sketches = []
    monkeypatch.setattr(jaccard.F, "approx_count_distinct", lambda *a, **k: sketches.append(a))
    common = "one two three four five"
    rows = [(i, f"{common} tail{i} and more words") for i in range(jaccard.OFTEN)]
    rows += [(100 + i, "copy of a text that many rows hold") for i in range(40)]
    rows += [(200 + i, f"six seven eight nine ten other{i} end of it") for i in range(jaccard.OFTEN - 1)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    want, _ = shingles.sets(pa.array([common]))
    assert jaccard.frequent(df, "k", "t").tolist() == want.tolist()
    assert not sketches
