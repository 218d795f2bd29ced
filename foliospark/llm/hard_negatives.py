"""Hard negatives by exact integer products, scored with subset sums (Four Russians).

An anchor's components are taken eight at a time: a table holds the sum of every subset of the
eight. A candidate is stored as bit planes, a byte for every eight components and bit, so a byte
picks one entry, and the product is shifted and added plane by plane, from the sign down.
Anchors are a stated query set; they meet all candidates in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .vectors import finite, matrix

#: Candidates of a block, and anchors that meet it in one task.
BLOCK_ROWS, ANCHOR_ROWS = 16_384, 16_384
#: Anchors whose tables are held at a time, and candidates that are looked up at a time.
TABLE_ROWS, LOOK_UP = 64, 2_048
LONG = np.iinfo(np.int64)


def planes(vectors: np.ndarray) -> np.ndarray:
    """Bit planes of integer vectors, the sign's first: bytes of shape (bits, groups, rows).

    The lowest bit of a byte is the first of its eight components. There are as many planes as
    the largest component needs in two's complement."""
    rows, width = vectors.shape
    groups = -(-width // 8)
    most = int(np.where(vectors < 0, ~vectors, vectors).max(initial=0))
    bits = most.bit_length() + 1
    padded = np.zeros((rows, groups * 8), np.int64)
    padded[:, :width] = vectors
    out = np.empty((bits, groups, rows), np.uint8)
    for b in range(bits):
        plane = ((padded >> (bits - 1 - b)) & 1).astype(np.uint8).reshape(rows, groups, 8)
        out[b] = np.packbits(plane, axis=2, bitorder="little")[:, :, 0].T
    return out


def tables(anchors: np.ndarray, groups: int) -> np.ndarray:
    """Sums of all subsets of eight components: shape (groups, 256, anchors)."""
    n, width = anchors.shape
    padded = np.zeros((n, groups * 8), np.int64)
    width = min(width, groups * 8)
    padded[:, :width] = anchors[:, :width]
    eights = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 256, n), np.int64)
    for i in range(8):  # each component doubles the subsets
        out[:, 1 << i: 2 << i] = out[:, : 1 << i] + eights[:, i, None]
    return out


def products(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products, shape (candidates, anchors), from the tables of the anchors and the bit
    planes of the candidates. Exact modulo 2 ** 64."""
    bits, groups, rows = packed.shape
    out = np.zeros((rows, table.shape[2]), np.int64)
    plane = np.empty_like(out)
    entry = np.empty_like(out)
    for b in range(bits):
        np.take(table[0], packed[b, 0], axis=0, out=plane, mode="clip")
        for g in range(1, groups):
            np.take(table[g], packed[b, g], axis=0, out=entry, mode="clip")
            plane += entry
        if b == 0:
            np.subtract(out, plane, out=out)  # the sign's plane counts negative
        else:
            out <<= 1
            out += plane
    return out


def _exact(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products beyond 64 bits, in Python's integers, cut to the ends of the range."""
    width = min(anchors.shape[1], vectors.shape[1])
    wide = vectors[:, :width].astype(object) @ anchors[:, :width].astype(object).T
    return np.clip(wide, int(LONG.min), int(LONG.max)).astype(np.int64)


class Block:
    """Candidates of one task: keys, labels, vectors as bit planes."""

    def __init__(self, table: pa.Table):
        self.ids = table["id"].to_numpy()
        self.codes = table["code"].to_numpy()
        self.vectors = matrix(table["v"]).astype(np.int64)
        if not self.vectors.shape[1]:
            self.vectors = np.zeros((len(self.ids), 1), np.int64)
        self.most = float(np.abs(self.vectors.astype(np.float64)).max(initial=0.0))
        self.packed = planes(self.vectors)

    def scores(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First row and products (anchors, rows) of a few candidates at a time."""
        bound = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0.0)) * self.most
        small = bound < 2.0**62
        table = tables(anchors, self.packed.shape[1]) if small else None
        for start in range(0, len(self.ids), LOOK_UP):
            if small:
                part = products(table, self.packed[:, :, start: start + LOOK_UP])
            else:
                part = _exact(anchors, self.vectors[start: start + LOOK_UP])
            yield start, part.T

    def ranked(self, anchors: np.ndarray, use) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each anchor (scores, keys) of the candidates that ``use`` keeps, best first."""
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in anchors]
        for start, part in self.scores(anchors):
            stop = start + part.shape[1]
            row, column = np.nonzero(use(part, self.ids[start:stop], self.codes[start:stop]))
            cuts = np.searchsorted(row, np.arange(len(anchors) + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                at = column[cuts[i]: cuts[i + 1]]
                found[i].append((part[i, at], self.ids[start + at]))
        out = []
        for kept in found:
            if not kept:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            score, key = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((key, ~score))
            out.append((score[order], key[order]))
        return out


def _met(
    candidates: DataFrame, anchors: DataFrame, by: list[str], rows: int, asking: int, run, schema: str
) -> DataFrame:
    """``run(block, anchors)`` over blocks of candidates and of anchors with equal ``by``.

    A task sorts the candidates of its block before the anchors, holds the block only, and
    reads the anchors a few at a time."""
    blocks, parts = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-asking // ANCHOR_ROWS))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).select("*", copies)

    none = F.lit(None).cast("array<long>")
    left = dealt(candidates, "_i", blocks, "_j", parts).withColumn("_role", F.lit(0)).withColumn("asked", none)
    right = dealt(anchors, "_j", parts, "_i", blocks).withColumn("_role", F.lit(1))
    keys = [*by, "_i", "_j"]
    columns = [*dict.fromkeys([*keys, "_role", "id", "code", "v", "asked"])]
    both = left.select(*columns).unionByName(right.select(*columns))
    ordered = both.repartition(*keys).sortWithinPartitions(*keys, "_role", "id")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, key = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in [*keys, "_role"]])
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                now, role = tuple(marks[lo, :-1]), marks[lo, -1]
                if now != key:
                    held, block, key = [], None, now
                if role == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if block is None:
                    if not held:  # anchors without a candidate
                        continue
                    block, held = Block(pa.Table.from_batches(held)), []
                for start in range(lo, hi, TABLE_ROWS):
                    yield run(block, batch.slice(start, min(TABLE_ROWS, hi - start)))

    return ordered.mapInArrow(task, schema)


def _best(df: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, key: str, label: Column, vector: str, anchors: Column, scale: int = 256,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components count as floor(scale * x). The positives of a row for which ``anchors`` holds
    are the first ``positives`` other rows of its label by inner product, ties to the smaller
    key; for each, the first ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's, bounds included.

    Rows without a key or label, and vectors that are null or hold a null or infinite
    component, take no part. A repeated key counts once, with its smallest label and vector.
    Short vectors count as filled up with zeros; an empty vector scores 0. Components and
    scores beyond 64 bits are cut to the ends of that range."""
    x, good = finite(vector)
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    points = (
        df.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.when(good, whole).alias("v"), anchors.alias("ask"))
        .filter("id is not null and label is not null and v is not null")
        .groupBy("id").agg(F.min(F.struct("label", "v")).alias("p"), F.max("ask").alias("ask"))
        .select("id", "p.label", "p.v", "ask")
        .withColumn("code", F.xxhash64("label"))  # labels of any type meet as 64-bit numbers
    )
    points = stored(points, "vectors")
    rows, asking = points.agg(F.count("*"), F.count_if("ask")).first()
    asked = points.filter("ask").withColumn("asked", F.array().cast("array<long>"))

    def near(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch["id"].to_numpy()
        vectors = matrix(batch["v"]).astype(np.int64)
        floor = np.full(len(own), LONG.min)

        def use(part, ids, codes):
            keep = (part >= floor[:, None]) & (own[:, None] != ids)
            # The k-th best of these rows is a bound for all that follow.
            if positives < part.shape[1]:
                kth = -np.partition(np.where(keep, ~part, LONG.max), positives - 1, axis=1)[:, positives - 1] - 1
                np.maximum(floor, np.where(keep.sum(axis=1) >= positives, kth, LONG.min), out=floor)
                keep &= part >= floor[:, None]
            return keep

        out = [(i, s[:positives], k[:positives]) for i, (s, k) in zip(own, block.ranked(vectors, use))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(own, [len(s) for _, s, _ in out]), pa.int64()),
                pa.array(np.concatenate([k for *_, k in out]), pa.int64()),
                pa.array(np.concatenate([s for _, s, _ in out]), pa.int64()),
            ],
            names=["anchor_id", "positive_id", "positive_score"],
        )

    like = _met(points, asked, ["code"], rows, asking, near, "anchor_id long, positive_id long, positive_score long")
    like = stored(_best(like, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")

    # Below 0 nothing lies between the hundredths.
    wanted = like.filter("positive_score >= 0") if low < high else like
    scores = wanted.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("asked"))
    second = points.filter("ask").join(scores, "id")

    def apart(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, code = batch["id"].to_numpy(), batch["code"].to_numpy()
        vectors = matrix(batch["v"]).astype(np.int64)
        asked = [sorted(a) for a in batch["asked"].to_pylist()]
        first = np.array([max(min(-(-low * p // 100) for p in a), LONG.min) for a in asked], np.int64)
        last = np.array([min(max(high * p // 100 for p in a), LONG.max) for a in asked], np.int64)

        def use(part, ids, codes):
            return (part >= first[:, None]) & (part <= last[:, None]) & (code[:, None] != codes)

        out = []
        for i, (score, ids) in enumerate(block.ranked(vectors, use)):
            down = ~score  # ascending
            for p in asked[i]:
                at = np.searchsorted(down, ~np.int64(min(max(high * p // 100, LONG.min), LONG.max)), side="left")
                for s, k in zip(score[at: at + negatives].tolist(), ids[at: at + negatives].tolist()):
                    if 100 * s < low * p:
                        break
                    out.append((int(own[i]), p, k, s))
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            names=["anchor_id", "positive_score", "negative_id", "negative_score"],
        )

    schema = "anchor_id long, positive_score long, negative_id long, negative_score long"
    unlike = _met(points, second, [], rows, asking, apart, schema)
    best = _best(unlike, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return like.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
