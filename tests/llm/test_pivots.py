"""Near copies of vectors against all pairs."""

import numpy as np
import pytest
from oracle import connect, difference

from foliospark.llm import pivots, queries


def all_pairs(rows, cosine=0.93):
    """Links and components of (id, label, vector) rows, by every pair."""
    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if a is not None and a == b:
                if np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= cosine:
                    near[i].append(j)
                    near[j].append(i)
    low = list(range(n))
    for start in range(n):
        if low[start] != start:
            continue
        todo = [start]
        while todo:
            i = todo.pop()
            for j in near[i]:
                if low[j] > start:
                    low[j] = start
                    todo.append(j)
    return {rows[i][0]: (len(near[i]), rows[low[i]][0]) for i in range(n)}


def result(spark, rows):
    df = spark.createDataFrame([(i, l, [float(x) for x in v], "x") for i, l, v in rows], "vec_id long, label int, embedding array<double>, n string")
    got = pivots.near_copies(df, "vec_id", "label", "embedding").collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


@pytest.mark.parametrize("chunk,noise", [(2048, 0.1), (40, 0.1), (40, 0.35)])
def test_groups(spark, monkeypatch, chunk, noise):
    """A group of a third of all rows, small groups, exact copies and rows on their own; with
    wide groups, balls leave pairs open, which are verified one by one."""
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=24)) for i in range(400)]
    base = rng.normal(size=24)
    base /= np.linalg.norm(base)
    for i in range(400, 600):
        d = rng.normal(size=24)
        rows.append((i, 1, base + noise * rng.uniform(0.5, 1.5) * d / np.linalg.norm(d)))
    for i in range(600, 640):
        k = int(rng.integers(0, 20))
        rows.append((i, rows[k][1], rows[k][2] * 2 + (0.0 if i % 2 else 0.02) * rng.normal(size=24)))
    want, got = all_pairs(rows), result(spark, rows)
    links = sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * links
    assert links > 5_000
    if noise == 0.1:
        assert got == want


@pytest.mark.parametrize("width", [1, 2, 3])
def test_narrow(spark, width):
    rng = np.random.default_rng(4)
    rows = [(i, 0, rng.normal(size=width)) for i in range(150)]
    want, got = all_pairs(rows), result(spark, rows)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_odd_rows(spark):
    big = 1e200
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None),
        (6, 0, [0.0, 0.0]), (7, 0, [1.0, None]), (8, 0, [float("nan"), 1.0]), (9, 0, [float("inf"), 1.0]),
        (10, 0, []), (11, 0, [big, 0.0]), (12, 0, [3.0]), (13, 0, [0.0, 1.0]), (13, 0, [0.0, 1.0]), (None, 0, [0.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    df = df.selectExpr("*", "1 AS row", "'a' AS cell", "2 AS unit")
    got = pivots.near_copies(df, "vec_id", "label", "embedding").collect()
    found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got)
    same = [(i, 3, 1) for i in (1, 2, 11, 12)] + [(i, 0, i) for i in range(3, 11)]
    assert found == sorted(same + [(13, 2, 13), (13, 2, 13), (0, 2, 13)])
    assert pivots.near_copies(df.limit(0), "vec_id", "label", "embedding").count() == 0


def test_permutations():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    p = pivots.choose(v, 40)
    near = p @ p.T
    assert len(p) == 40 and (near - 2 * np.eye(40)).max() < pivots.APART
    got = pivots.permutation(v, p, 8)
    assert (got == np.argsort(-(v @ p.T), axis=1, kind="stable")[:, :8]).all()


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op11_near_vectors(spark, d).toPandas()
    assert difference(got, connect(d).execute(queries.SQL["op11_near_vectors"]).df()) is None
