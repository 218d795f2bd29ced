"""Top-k search against all products."""

import numpy as np
import pytest
from oracle import connect, difference

from foliospark.llm import mtree, queries


def best(ids, vectors, query, own, k):
    score = vectors @ query
    rows = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != own)[:k]
    return [(-s, i) for s, i in rows]


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "few"])
def test_tree(kind):
    rng = np.random.default_rng(1)
    n = 7 if kind == "few" else 3000
    v = rng.integers(-40, 40, (n, 8))
    if kind == "clusters":
        v = v[rng.integers(0, 12, n)] * 3 + rng.integers(-1, 2, (n, 8))
    if kind == "equal":
        v[: n // 2] = v[0]
    ids = rng.permutation(n)
    tree = mtree.MTree(ids, v)
    rows = np.arange(0, n, 97)
    got, total = tree.search(v[rows].astype(float), ids[rows], 20)
    for q, own in zip(rows, got):
        assert own == best(ids, v, v[q], ids[q], 20)
    if kind == "clusters":
        assert total < 0.6 * n * len(rows)  # pages and entries are ruled out


def test_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 50)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 5)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(300)]
    bad = [(301, None, "x"), (302, [1.0, None], "x"), (303, [float("nan")] * 6, "x"),
           (304, [float("inf")] * 6, "x"), (None, [9.0] * 6, "x")]
    df = spark.createDataFrame(rows + bad + rows[:40], "vec_id long, embedding array<double>, rank string")
    got = mtree.top_k(df, "vec_id", "embedding", df.vec_id % 20 == 0, 20).collect()
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(int)
    for q in range(0, 300, 20):
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        want = best(range(300), v, v[q], q, 20)
        assert own == [(n + 1, s, i) for n, (s, i) in enumerate(want)]
    assert len(got) == 15 * 20
    two = spark.createDataFrame([(0, [1.0], "x"), (5, [0.5, 3.0], "x")], df.schema)
    got = mtree.top_k(two, "vec_id", "embedding", two.vec_id % 20 == 0, 20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 5, 64 * 32)]
    none = df.limit(0)
    assert mtree.top_k(none, "vec_id", "embedding", none.vec_id % 20 == 0, 20).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op8_top_products(spark, d).toPandas()
    assert difference(got, connect(d).execute(queries.SQL["op8_top_products"]).df()) is None


def test_large_values(spark, monkeypatch):
    """Products beyond 2 ** 42, beyond 2 ** 53, and beyond 64 bits, against Python's integers."""
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    for scale in (1e3, 1e6, 1e8, 1e16):
        rows = [(i, [float(x) for x in rng.normal(size=4) * scale]) for i in range(120)]
        rows += [(200, [1e6, 1.0]), (201, [1e6, 1.0]), (202, [1e6, 0.0]), (240, [1e6, 1.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = mtree.top_k(df, "vec_id", "embedding", df.vec_id % 20 == 0, 20).collect()
        v = {i: [int(np.floor(64 * x)) for x in r] for i, r in rows}
        for q in (0, 20, 100, 200, 240):
            score = {i: sum(x * y for x, y in zip(v[q], v[i])) for i in v if i != q}
            want = sorted((max(min(s, mtree.LONG.max), mtree.LONG.min), i) for i, s in score.items())
            own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
            want = sorted(((-s, i) for s, i in want))[:20]
            assert own == [(n + 1, -s, i) for n, (s, i) in enumerate(want)]
