"""Near copies of vectors: an index of pivot permutations.

A vector is described by its nearest reference points, nearest first. Vectors around one centre,
so close that all of them are linked, become a cell first, which keeps large groups of near
copies linear. Cells that share enough of their nearest pivots meet through inverted lists;
balls decide most of them, and what the balls leave open is verified vector by vector."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import bound
from .common import sample, stored
from .components import components
from .vectors import dot, finite, lists, matrix

#: Pivots come from a sample of this many vectors; no two are nearer than this cosine.
SAMPLE_ROWS, APART = 8_192, 0.8
#: Fewest and most pivots looked for; one for every 64 vectors between.
FEWEST, MOST = 512, 4_096
#: Nearest pivots that describe a vector, and how many two vectors have to share.
NEAREST, SHARED = 8, 3
#: List entries that a cell may meet by chance, on average.
CHANCE = 100.0
#: Cells that are compared with one another at a time.
CHUNK = 2_048
#: Above the rounding error of an angle.
MARGIN = 1e-7

CELL = "cell long, label {label}, centre array<double>, n long, r double, low long"


def _unit(vector: str) -> Column:
    """The vector divided by its length; null if it is null, zero, or holds a null or infinite
    component. Divided by its largest component first, so that no square overflows."""
    x, good = finite(vector)

    def over(y: Column) -> Column:
        length = F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v))
        return bound(length, lambda l: F.transform(y, lambda v: v / l))

    def scaled(x: Column) -> Column:
        most = F.array_max(F.transform(x, F.abs))
        return bound(most, lambda m: F.when(m > 0, bound(F.transform(x, lambda v: v / m), over)))

    return F.when(good, bound(x, scaled))


def choose(vectors: np.ndarray, most: int) -> np.ndarray:
    """Of unit vectors, in order, those that are not near one chosen before, ``most`` at most.

    A large group of near copies would otherwise fill the permutations of its members with
    pivots that only noise tells apart."""
    kept = np.zeros((min(most, len(vectors)), vectors.shape[1]))
    n = 0
    for v in vectors:
        if n == len(kept):
            break
        if n == 0 or (kept[:n] @ v).max() < APART:
            kept[n] = v
            n += 1
    return kept[:n]


def permutation(vectors: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest pivots of each vector, nearest first, ties by number."""
    near = vectors @ pivots.T
    n = min(n, len(pivots))
    some = np.argpartition(-near, n - 1, axis=1)[:, :n]
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def gather(
    centres: np.ndarray, n: np.ndarray, r: np.ndarray, code: np.ndarray, reach: float
) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Balls of one ``code`` merged into balls of at most ``reach``: ``(members, centre, radius)``
    for each that has several.

    The ball with most others in reach goes first; it is centred on the mean of what it holds."""
    near = centres @ centres.T >= np.cos(np.maximum(reach - r, 0.0))[None, :]
    near &= (r <= reach)[None, :] & (code[:, None] == code[None, :])
    np.fill_diagonal(near, True)
    degree = near.sum(axis=1)
    free = np.ones(len(centres), bool)
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] < 2:
            break
        members = np.flatnonzero(free & near[i]) if free[i] else ()
        if len(members) < 2:
            continue
        centre = (centres[members] * n[members, None]).sum(axis=0)
        length = math.sqrt((centre**2).sum())
        if length == 0:
            continue
        centre /= length
        rest = np.flatnonzero(free & (code == code[i]))
        radius = np.arccos(np.clip(centres[rest] @ centre, -1.0, 1.0)) + r[rest] + MARGIN / 100
        inside = radius <= reach
        if inside.sum() < 2:
            continue
        free[rest[inside]] = False
        yield rest[inside], centre, float(radius[inside].max())


def _merge(cells: DataFrame, pivots: np.ndarray, reach: float, label: str) -> DataFrame:
    """One round: each cell with its parent, and the parent's own row with the merged cell.

    Cells with the same nearest pivot are compared in chunks. Partitions are ranges that a hash
    subdivides, so a pivot that most cells share is dealt to many tasks. Cells that a chunk's
    end parts are merged in the next round, or stay two cells."""

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                first = permutation(matrix(part["centre"], pivots.shape[1]), pivots, 1)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(first, pa.int32())], names=[*part.schema.names, "pivot"]
                )

    def merged(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        cell = table["cell"].to_numpy()
        centres = matrix(table["centre"]).copy()
        n, r = table["n"].to_numpy().copy(), table["r"].to_numpy().copy()
        low = table["low"].to_pylist()
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        code = label * np.int64(len(pivots)) + table["pivot"].to_numpy()
        parent = cell.copy()
        for members, centre, radius in gather(centres.copy(), n.copy(), r.copy(), code, reach):
            head = members[np.argmin(cell[members])]
            parent[members] = cell[head]
            centres[head], n[head], r[head] = centre, n[members].sum(), radius
            low[head] = min((low[i] for i in members if low[i] is not None), default=None)
        own = parent == cell
        ends = np.concatenate(([0], np.cumsum(own))).astype(np.int32) * centres.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cell), pa.array(parent), table["label"].combine_chunks(),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(centres[own].ravel())),
                pa.array(n), pa.array(r), pa.array(low, pa.int64()),
            ],
            names=["cell", "parent", "label", "centre", "n", "r", "low"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == CHUNK:
                    yield merged(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield merged(pa.Table.from_batches(held))

    placed = cells.mapInArrow(nearest, CELL.format(label=label) + ", pivot int")
    dealt = placed.withColumn("_h", F.xxhash64("cell")).repartitionByRange("label", "pivot", "_h")
    dealt = dealt.sortWithinPartitions("label", "pivot", "_h").drop("_h")
    schema = CELL.format(label=label).replace("cell long", "cell long, parent long")
    return stored(dealt.mapInArrow(run, schema), "cells")


def _depth(rows: int, pivots: int) -> int:
    """Pivots that one inverted list stands for: as few as keep chance meetings rare."""
    nearest = min(NEAREST, pivots)
    shared = min(SHARED, nearest)
    for depth in range(1, shared):
        first = nearest - shared + depth
        if rows * math.comb(first, depth) ** 2 / math.comb(pivots, depth) <= CHANCE:
            return depth
    return shared


def candidates(cells: DataFrame, pivots: np.ndarray, rows: int, label: str) -> DataFrame:
    """Pairs ``(a, b)`` of cells of one label, a < b, that share enough nearest pivots.

    Lists stand for sets of ``depth`` pivots: two cells that share ``SHARED`` of ``NEAREST``
    have their first ``depth`` common ones, by number, among the first few of either. A pair
    is made in the list of those, so it comes out once."""
    nearest = min(NEAREST, len(pivots))
    shared, depth = min(SHARED, nearest), _depth(rows, len(pivots))
    picks = np.array(list(combinations(range(nearest - shared + depth), depth)), int).reshape(-1, max(depth, 1))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                near = permutation(matrix(part["centre"], pivots.shape[1]), pivots, nearest)
                near = np.sort(near, axis=1)
                key = np.zeros((len(near), len(picks)), np.int64)
                for d in range(depth):
                    key = key * len(pivots) + near[:, picks[:, d]]
                yield pa.RecordBatch.from_arrays(
                    [part["cell"], part["label"], lists(near.astype(np.int16)), lists(key)],
                    names=["cell", "label", "near", "keys"],
                )

    listed = (
        cells.select(*[c.split()[0] for c in CELL.split(", ")])
        .mapInArrow(describe, f"cell long, label {label}, near array<short>, keys array<long>")
        .select("label", F.explode("keys").alias("key"), "cell", "near")
    )
    a, b = listed.alias("a"), listed.alias("b")
    common = F.array_intersect("a.near", "b.near")
    at = F.lit(0).cast("long")
    for d in range(depth):
        at = at * len(pivots) + F.get("common", F.lit(d))
    return (
        a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.cell") < F.col("b.cell")))
        .select(F.col("a.key").alias("key"), F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), common.alias("common"))
        .filter((F.size("common") >= shared) & (at == F.col("key")))
        .select("a", "b")
    )


def near_copies(df: DataFrame, key: str, label: str, vector: str, cosine: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``df``.

    Two rows are linked when their labels are equal and not null and the cosine of their
    vectors, in double precision, is ``cosine`` or more. Pairs that share fewer than ``SHARED``
    of their ``NEAREST`` pivots are not found; of random pairs at a cosine of 0.93 about 3 in
    100 are lost, of nearer ones fewer. ``component_id`` is the smallest key that can be reached.

    Vectors that are null, zero, or hold a null or infinite component link with nothing; so do
    rows without a label. A shorter vector counts as filled up with zeros. Rows that share a
    key are rows of their own, which share ``kept``. A row without a key is counted in the
    links of others; its own component has the smallest key in it, null if there is none."""
    theta = math.acos(cosine)
    rows = stored(
        df.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"),
            F.col(label).alias("label"), _unit(vector).alias("unit"),
        ),
        "vectors",
    )
    kind = rows.schema["label"].dataType.simpleString()
    valid = rows.filter("label is not null and unit is not null")
    total = valid.count()
    table = sample(valid.select("row", "unit"), "row", SAMPLE_ROWS).orderBy(F.xxhash64("row")).select("unit").toArrow()
    seen = matrix(table["unit"]) if table.num_rows else np.zeros((0, 1))
    pivots = choose(seen, min(max(FEWEST, total // 64), MOST))

    # Cells: balls so small that any two vectors inside are linked.
    leaves = valid.select(
        F.col("row").alias("cell"), "label", F.col("unit").alias("centre"), F.lit(1).cast("long").alias("n"),
        F.lit(0.0).alias("r"), F.col("vec_id").alias("low"),
    )
    levels = [_merge(leaves, pivots, theta / 2, kind)]
    made = levels[0].filter("cell = parent").drop("parent")
    single, large = made.filter("n = 1"), made.filter("n > 1")
    before, now = 0, large.count()
    while now > 1 and now != before:
        levels.append(_merge(large, pivots, theta / 2, kind))
        large = levels[-1].filter("cell = parent").drop("parent")
        before, now = now, large.count()
    cells = single.unionByName(large)

    # Pairs of cells: linked as a whole, not linked, or open.
    ball = cells.select("cell", "centre", "n", "r")
    pair = candidates(cells, pivots, total, kind)
    for side in ("a", "b"):
        renamed = ball.select(*[F.col(c).alias(f"{c}_{side}") for c in ball.columns])
        pair = pair.join(renamed, F.col(side) == F.col(f"cell_{side}"))
    turn = F.acos(F.greatest(F.least(F.col("dot"), F.lit(1.0)), F.lit(-1.0)))
    alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    wide = F.col("r_a") + F.col("r_b")
    state = (
        F.when(alone, F.when(F.col("dot") >= cosine, 1).otherwise(0))
        .when(turn + wide <= theta - MARGIN, 1).when(turn - wide > theta + MARGIN, 0).otherwise(2)
    )
    pair = pair.withColumn("dot", dot("centre_a", "centre_b"))
    pair = stored(pair.select("a", "b", "n_a", "n_b", state.alias("state")).filter("state > 0"), "cell-pairs")

    def both(which: DataFrame) -> DataFrame:
        flip = which.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))
        return which.select("a", "b", "n_a", "n_b").unionByName(flip)

    # Open pairs: a vector against a ball, then against the vectors of that ball.
    more = None
    links = pair.filter("state = 1").select("a", "b")
    if not pair.filter("state = 2").isEmpty():
        home = levels[0].select(F.col("cell").alias("row"), F.col("parent").alias("cell"))
        for level in levels[1:]:
            up = level.select("cell", F.col("parent").alias("_up"))
            home = home.join(up, "cell", "left").select("row", F.coalesce("_up", "cell").alias("cell"))
        home = home.join(rows.select("row", "unit"), "row")
        other = ball.select(F.col("cell").alias("b"), "centre", "r", "n")
        faced = home.join(both(pair.filter("state = 2")).select("a", "b"), F.col("cell") == F.col("a")).join(other, "b")
        turn = F.acos(F.greatest(F.least(dot("unit", "centre"), F.lit(1.0)), F.lit(-1.0)))
        faced = faced.withColumn("_turn", turn)
        inside = F.col("_turn") + F.col("r") <= theta - MARGIN
        whole = faced.filter(inside).select("row", "a", "b", F.col("n").alias("found"))
        unsure = faced.filter(~inside & (F.col("_turn") - F.col("r") <= theta + MARGIN)).select("row", "a", "b", "unit")
        inner = home.select(F.col("cell").alias("b"), F.col("unit").alias("unit_b"))
        exact = (
            unsure.join(inner, "b").filter(dot("unit", "unit_b") >= cosine)
            .groupBy("row", "a", "b").agg(F.count("*").alias("found"))
        )
        tried = stored(whole.unionByName(exact), "row-pairs")
        more = tried.groupBy("row").agg(F.sum("found").alias("more"))
        links = links.unionByName(tried.select("a", "b").distinct())

    reached = components(links)
    added = both(pair.filter("state = 1")).groupBy(F.col("a").alias("cell")).agg(F.sum("n_b").alias("added"))
    known = (
        cells.select("cell", "n", "low").join(reached, F.col("cell") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "cell"))
    )
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    result = (
        known.join(least, "component").join(added, "cell", "left")
        .select("cell", (F.col("n") - 1 + F.coalesce("added", F.lit(0))).alias("links"), "component_id")
    )
    # Down the levels again: a cell has at most CHUNK parts at each, so no key is hot.
    result = stored(result, "cell-results")
    for level in levels[:0:-1]:
        parts = level.select(F.col("cell").alias("part"), F.col("parent").alias("cell"))
        moved = parts.join(result, "cell").select(F.col("part").alias("cell"), "links", "component_id")
        result = moved.unionByName(result.join(single.select("cell"), "cell", "left_semi"))
    found = (
        levels[0].select(F.col("cell").alias("row"), F.col("parent").alias("cell")).join(result, "cell").drop("cell")
    )
    out = rows.select("row", "vec_id").join(found, "row", "left")
    n_links = F.coalesce("links", F.lit(0).cast("long"))
    if more is not None:
        out = out.join(more, "row", "left")
        n_links = n_links + F.coalesce("more", F.lit(0).cast("long"))
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id")
    )
