"""Suffix arrays against sorting, and removed bytes against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import grouping, queries, substrings

SF_DIR = "/root/testdata/sf0.001"
N = substrings.LENGTH


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(150):
        texts = [
            [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, rng.choice([3, 12, 60])))] + [0]
            for _ in range(rng.randint(1, 9))
        ]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = grouping.suffix_arrays(np.array(sum(texts, [])), starts)
        for t, a, b in zip(texts, starts, starts[1:]):
            assert (got[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    last = float("inf")
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - N + 1):
            s = data[i : i + N]
            first[s] = min(first.get(s, last), last if key is None else key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        off = [False] * len(data)
        for i in range(len(data) - N + 1):
            if first[data[i : i + N]] < (last if key is None else key):
                off[i : i + N] = [True] * N
        kept = bytes(c for c, o in zip(data, off) if not o)
        spans = sum(o and not (i and off[i - 1]) for i, o in enumerate(off))
        out.append((key, len(data), sum(off), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    got = substrings.dedup(df, "doc_id", "text")
    return sorted((tuple(r)[:5] for r in got.drop("kept").collect()), key=str)


@pytest.mark.parametrize("large", [6_000, 100])
def test_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(substrings, "LARGE", large)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 700)
    monkeypatch.setattr(substrings, "BIN_BYTES", 5_000)
    rng = random.Random(large)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passages = [noise(rng.randint(40, 160)) for _ in range(8)] + ["ab" * 60, "a" * 130]
    rows = []
    for i in range(90):
        text = noise(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = rng.choice("xyz")
            text += "".join(p) + noise(rng.randint(0, 60))
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "a" * 49), (203, "a" * 50), (None, rows[3][1]), (None, passages[0])]
    rows += [(5, rows[5][1]), (5, passages[1]), (204, noise(9_000) + passages[2]), (205, rows[7][1]), (206, rows[7][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    got = result(df)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 3_000


def test_edges(spark):
    schema = "doc_id long, text string"
    assert result(spark.createDataFrame([], schema)) == []
    rows = [(1, None), (2, "short"), (3, "")]
    assert result(spark.createDataFrame(rows, schema)) == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in queries.op3_repeated_bytes(spark, SF_DIR).collect()), key=str)
    assert got == brute(rows)


def test_what_cannot_repeat_is_not_sorted(monkeypatch):
    """Near copies, each with one byte changed: their segments are few bytes to an anchor, and
    most windows are equal to all others or to none."""
    rng = random.Random(4)
    rows = []
    for h in range(40):
        base = [rng.choice(b"abcdefgh") for _ in range(78)]
        for _ in range(8):
            seg = base.copy()
            seg[rng.choice([*range(28), *range(48, 78)])] = 120
            low = rng.randint(0, 9)
            rows.append((h << 32, 28, len(rows), bytes(seg), low, low + rng.randint(0, 9), rng.randint(0, 5)))
    rows.sort(key=lambda r: r[:3])
    names = ("h", "at", "name", "seg", "low", "high", "block")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))
    size = []
    sort = substrings.suffix_arrays
    monkeypatch.setattr(substrings, "suffix_arrays", lambda flat, starts: size.append(len(flat)) or sort(flat, starts))
    got = pa.Table.from_batches(substrings.classes([batch.slice(0, 101), batch.slice(101)])).to_pylist()
    least = {}
    for h, at, _, seg, low, _, _ in rows:
        for w in range(len(seg) - N + 1):
            k = (h, seg[w : w + N])
            least[k] = min(low, least.get(k, low))
    want = {}
    for h, at, name, seg, low, high, block in rows:
        keys = [least[h, seg[w : w + N]] for w in range(len(seg) - N + 1)]
        if high > min(keys):
            want[name] = (block, h >> 32, min(keys), keys)

    def keys_of(r):
        if r["runs"] is None:
            return [r["least"]] * (len(rows[order[r["seg"]]][3]) - N + 1)
        count, keys = np.frombuffer(r["runs"], np.int64).reshape(2, -1)
        return np.repeat(keys, count).tolist()

    order = {r[2]: i for i, r in enumerate(rows)}
    assert {r["seg"]: (r["block"], r["h"], r["least"], keys_of(r)) for r in got} == want
    assert len(got) == len(want) > 100 and any(r["runs"] for r in got)
    assert 0 < sum(size) < sum(len(r[3]) for r in rows)
