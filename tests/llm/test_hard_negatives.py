"""Hard negatives against all products in Python's integers."""

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from foliospark.llm import hard_negatives as H
from foliospark.llm import queries


def brute(rows, asks, scale=256, positives=5, negatives=5, low=80, high=100):
    points = {i: (l, [int(np.floor(x * scale)) for x in v]) for i, l, v in rows}
    out = []
    for a in points:
        if not asks(a):
            continue
        la, va = points[a]
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in points.items() if i != a}
        best = sorted((i for i in score if points[i][0] == la), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            fit = [i for i in score if points[i][0] != la and low * score[p] <= 100 * score[i] <= high * score[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:negatives], 1):
                out.append((a, p, rank, i, score[p], score[i]))
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(i, l, [float(x) for x in v], "x") for i, l, v in rows], "id long, label int, v array<double>, rank string")
    return sorted(map(tuple, H.mine(df, "id", F.col("label"), "v", df.id % every == 0, **more).collect()))


def test_tables():
    rng = np.random.default_rng(1)
    for width in (1, 7, 8, 19, 64):
        a, c = rng.integers(-900, 900, (5, width)), rng.integers(-70_000, 3, (40, width))
        packed = H.planes(c)
        assert (H.products(H.tables(a, packed.shape[1]), packed) == c @ a.T).all()
    zero = np.zeros((3, 4), np.int64)
    assert (H.products(H.tables(zero, 1), H.planes(zero)) == 0).all()
    ends = np.array([[H.LONG.min, H.LONG.max, -1, 0]])
    one = np.array([[0, 1, 0, 0], [1, 0, 0, 0], [1, 1, 0, 0]])
    assert H.products(H.tables(one, 1), H.planes(ends)).tolist() == [[H.LONG.max, H.LONG.min, -1]]


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "negative"])
def test_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "BLOCK_ROWS", 60)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 9)
    monkeypatch.setattr(H, "TABLE_ROWS", 4)
    monkeypatch.setattr(H, "LOOK_UP", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(240, 9)) / 3
    if kind == "ties":
        v = rng.integers(-1, 2, (240, 3)) / 4
    if kind == "negative":
        v[1::2] = -np.abs(v[1::2])
        v[::2] = np.abs(v[::2])
    label = rng.integers(0, 4, 240)
    if kind == "hot":
        label[: 160] = 1
        v[: 80] = v[0]
    rows = [(i, int(l), x) for i, (l, x) in enumerate(zip(label, v))]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 100 or kind == "negative"
    wide = dict(positives=2, negatives=3, low=-50, high=40)
    assert mined(spark, rows, **wide) == brute(rows, lambda i: i % 10 == 0, **wide)


def test_large_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, rng.normal(size=3) * 1e6) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    rows = [(0, 0, [1e17, 0.0]), (1, 0, [1e17, 0.0]), (2, 1, [1e17, 1.0]), (3, 1, [1e300, 0.0]), (4, 1, [1.0, 0.0])]
    top = H.LONG.max
    assert mined(spark, rows) == [(0, 1, n, n + 1, top, top) for n in (1, 2, 3)]


def test_odd_rows(spark):
    rows = [
        (0, 0, [1.0, 0.0]), (1, 0, [1.0]), (2, 1, [0.9, 7.0]), (2, 1, [0.9, 7.0]), (3, None, [1.0, 0.0]), (4, 1, None),
        (5, 1, [None, 1.0]), (6, 1, [float("nan"), 0.0]), (7, 1, [float("inf"), 0.0]), (None, 1, [1.0, 0.0]), (8, 1, []),
    ]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").selectExpr("*", "1 AS code", "2 AS ask")
    got = H.mine(df, "id", F.col("label"), "v", df.id % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert H.mine(df.limit(0), "id", F.col("label"), "v", df.id % 10 == 0).count() == 0
    assert H.mine(df, "id", F.col("label"), "v", df.id < 0).count() == 0


def test_sql(spark):
    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        got = queries.op12_hard_negatives(spark, d).toPandas()
        assert difference(got, connect(d).execute(queries.SQL["op12_hard_negatives"]).df()) is None
