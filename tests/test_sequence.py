"""Block-wise ordered operators against plain loops, with tiny blocks and hot keys."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.operators import glossary as G
from foliospark.operators import router as RT
from foliospark.operators import sequence as SQ


def batches(sizes):
    out, n, chars, no = [], 0, 0, -1
    for size in sizes:
        cost = size + 180
        if no < 0 or n >= 8 or chars + cost > 12000:
            no, n, chars = no + 1, 0, 0
        n, chars = n + 1, chars + cost
        out.append(no)
    return out


def test_greedy_batches_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 3 + rng.randrange(3), rng.choice([5, 900, 4000, 13000])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o bigint, n int")
    for block in (16, 100_000):
        got = SQ.greedy_batches(df, "k", "o", F.col("n"), rows_per_block=block).collect()
        by_key = {}
        for r in sorted(got, key=lambda r: (r.k, r.o)):
            by_key.setdefault(r.k, []).append((r.size, r.batch_no))
        assert sum(map(len, by_key.values())) == len(rows)
        for items in by_key.values():
            assert [b for _, b in items] == batches([n for n, _ in items])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300), st.integers(1, 120)), min_size=1, max_size=80))
def test_chain(spark, items):
    unique = {(k, p): r for k, p, r in items}
    df = spark.createDataFrame([(k, p, p + r) for (k, p), r in unique.items()], "k int, p bigint, r bigint")
    got = {(r.k, r.p) for r in SQ.chain(df, "k", "p", "r", 10).collect()}
    want = set()
    for key in {k for k, _ in unique}:
        until = -1
        for p in sorted(p for k, p in unique if k == key):
            if p >= until:
                want.add((key, p))
                until = p + unique[key, p]
    assert got == want


def test_dense_ordinal(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), v) for v in rng.sample(range(10_000), 500)]
    got = SQ.dense_ordinal(spark.createDataFrame(rows, "k string, o bigint"), ["k"], "o", rows_per_block=20).collect()
    for k in "ab":
        assert [r.ordinal for r in sorted((r for r in got if r.k == k), key=lambda r: r.o)] == list(
            range(sum(r[0] == k for r in rows))
        )


def test_cooldown_replay(spark):
    rng = random.Random(5)
    rows, ts = [], 0
    for i in range(400):
        ts += rng.choice([0, 1, 20_000, 400_000])
        rows.append(("p" if rng.random() < 0.8 else "q", ts, i, rng.choice([0, 0, 60_000, 900_000, 86_400_000 if i == 200 else 0])))
    got = RT.replay(spark.createDataFrame(rows, "p string, ts bigint, i bigint, cd bigint"), "p", "ts", "i", "cd").collect()
    until, want = {}, {}
    for p, t, i, cd in rows:
        want[i] = until.get(p, 0) > t
        if cd and not want[i]:
            until[p] = t + cd
    assert {r.i: r.skipped for r in got} == want


def test_glossary_matches(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 12, 14, 15, 16, 22)] + ["ring", "a b"]
    texts = [(i, "".join(rng.choice("abcÉ .") for _ in range(rng.randrange(0, 400))) + (words[-3] if i % 3 else "")) for i in range(60)]
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "ord bigint, english string")
    docs = spark.createDataFrame(texts, "id bigint, text string")
    want = {
        (i, o) for i, t in texts for o, w in enumerate(words)
        if len(w.strip().lower()) >= 2 and w.strip().lower() in t.lower()
    }
    for few, texts_at_least in ((500_000, 1), (0, 1_000_000), (0, 1)):
        monkeypatch.setattr(G, "BROADCAST_ANCHORS", few)
        monkeypatch.setattr(G, "HOT_TEXTS", texts_at_least)
        monkeypatch.setattr(G, "HOT_SAMPLE", 40)
        hits = G.match_terms(docs, "id", "text", terms, top=None)
        assert {(r.id, r.ord) for r in hits.collect()} == want
    top = G.match_terms(docs, "id", "text", terms, top=3).collect()
    assert {(r.id, r.ord) for r in top} == {
        (i, o) for i, o in want if sum(1 for j, q in want if j == i and q < o) < 3
    }


def test_glossary_rows_of_one_key(spark):
    docs = spark.createDataFrame([(1, "a kidney"), (1, "a liver"), (None, "Kidney liver"), (None, "liver"), (1, "a liver"), (2, None)], "id bigint, text string")
    terms = spark.createDataFrame([(0, "kidney"), (1, "liver"), (2, "ne"), (3, "a liver that is not there")], "ord bigint, english string")
    got = sorted((r.id or 0, r.ord, r.rank) for r in G.match_terms(docs, "id", "text", terms).collect())
    assert got == sorted([(1, 0, 1), (1, 2, 2), (1, 1, 1), (1, 1, 1), (0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 1, 1)])
    assert G.match_terms(docs, "id", "text", terms.limit(0)).count() == 0


def test_splitters_far_values(spark):
    """One order value of 10 ** 18, and one of - 10 ** 18, leave no block too large."""
    rng = random.Random(9)
    near = rng.sample(range(50_000), 3000)
    for odd in ([10**18], [-(10**18), 10**18], [2**62 + i for i in range(500)]):
        df = spark.createDataFrame([(v,) for v in near + odd], "o bigint")
        split = SQ.splitters(df, "o", 50)
        sizes = [r["count"] for r in df.groupBy(split.of(F.col("o"))).count().collect()]
        assert max(sizes) <= 100 and len(sizes) >= 30
        got = SQ.dense_ordinal(df.withColumn("k", F.lit("a")), ["k"], "o", rows_per_block=50).collect()
        assert {r.o: r.ordinal for r in got} == {v: i for i, v in enumerate(sorted(near + odd))}


def test_splitters_equal_values(spark):
    values = [7] * 400 + list(range(1000, 1100))
    df = spark.createDataFrame([(v,) for v in values], "o bigint")
    split = SQ.splitters(df, "o", 20)
    sizes = {r[0]: r[1] for r in df.groupBy(split.of(F.col("o"))).agg(F.count("*"), F.min("o")).select("count(1)", "min(o)").collect() for r in [(r[1], r[0])]}
    assert sizes[7] == 400 and max(n for v, n in sizes.items() if v != 7) <= 40
    assert SQ.splitters(df.limit(0), "o").edges == [0]


def test_batches_with_a_far_unit(spark):
    rng = random.Random(8)
    orders = rng.sample(range(100_000), 600) + [10**18]
    rows = [("k", o, rng.choice([5, 900, 4000, 13000])) for o in orders]
    got = SQ.greedy_batches(spark.createDataFrame(rows, "k string, o bigint, n int"), "k", "o", F.col("n"), rows_per_block=16).collect()
    placed = sorted(got, key=lambda r: r.o)
    assert [r.batch_no for r in placed] == batches([r.size for r in placed])


def test_chain_between_splitters(spark):
    rng = random.Random(4)
    items = {(rng.randrange(2), rng.choice([rng.randrange(300), 10**15 + rng.randrange(300)])): rng.randrange(1, 90) for _ in range(250)}
    df = spark.createDataFrame([(k, p, p + r) for (k, p), r in items.items()], "k int, p bigint, r bigint")
    for size in (5, 1000):
        got = {(r.k, r.p) for r in SQ.chain(df, "k", "p", "r", SQ.splitters(df, "p", size)).collect()}
        want = set()
        for key in (0, 1):
            until = -1
            for p in sorted(p for k, p in items if k == key):
                if p >= until:
                    want.add((key, p))
                    until = p + items[key, p]
        assert got == want


def test_route(spark, monkeypatch):
    """Three providers with coupled holds, one account with most calls, against a plain loop."""
    rng = random.Random(6)
    rows, ts = [], 0
    for i in range(500):
        ts += rng.choice([0, 0, 1, 20_000, 400_000])
        fails = [rng.choice([None, None, None, 0, 60_000, 900_000, 86_400_000 if i % 90 == 5 else None]) for _ in range(3)]
        rows.append(("hot" if rng.random() < 0.8 else "cold", ts, i, *fails))
    monkeypatch.setattr(SQ, "ROWS_PER_BLOCK", 20)
    df = spark.createDataFrame(rows, "g string, ts bigint, i bigint, c0 bigint, c1 bigint, c2 bigint")
    got = {r.i: (r.served, r.failed, r.held) for r in RT.route(df, "g", "ts", "i", ["c0", "c1", "c2"]).collect()}
    until, want = {}, {}
    for g, t, i, *fails in rows:
        served, failed, held = None, 0, 0
        for k, c in enumerate(fails):
            if until.get((g, k), 0) > t:
                held += 1
                continue
            if c is None:
                served = k
                break
            failed += 1
            if c:
                until[g, k] = t + c
        want[i] = (served, failed, held)
    assert got == want
    assert RT.route(df.limit(0), "g", "ts", "i", ["c0"]).count() == 0


def test_a_small_glossary_meets_texts_in_their_tasks(spark, monkeypatch):
    """Nothing is shuffled, and both ways give the terms that ``in`` gives."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ab \n é") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(300, None), (300, "A B"), (None, "a b")]
    needles = sorted({text(rng.randrange(1, 9)).strip() for _ in range(300)} - {""} | {"  ", "a b", "a\nb a"})
    terms = spark.createDataFrame([(n * 3, w) for n, w in enumerate(needles)], "ord bigint, english string")
    frame = spark.createDataFrame(docs, "id int, text string").repartition(3)
    keys = [r.needle for r in G._needles(terms).collect()]
    assert "  " in keys
    ordered = G._needles(terms).orderBy("ord").collect()
    for top in (None, 4):
        want = []
        for i, t in docs:
            hits = [r.ord for r in ordered if r.needle in t.lower()] if t else []
            want += [(i or -1, o, n + 1) for n, o in enumerate(hits) if not top or n < top]
        for most, anchors in ((G.BROADCAST_TERMS, 0), (0, G.BROADCAST_ANCHORS), (0, 0)):
            with monkeypatch.context() as m:
                m.setattr(G, "BROADCAST_TERMS", most)
                m.setattr(G, "BROADCAST_ANCHORS", anchors)
                m.setattr(G, "HOT_TEXTS", 1)
                m.setattr(G, "HOT_SAMPLE", 40)
                got = G.match_terms(frame, "id", "text", terms, top=top)
                assert sorted((r.id or -1, r.ord, r.rank) for r in got.collect()) == sorted(want)
                if most:
                    plan = got._jdf.queryExecution().optimizedPlan().toString()
                    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
