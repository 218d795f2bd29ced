"""Exact top-k by inner product: best-first search in M-trees.

Every vector gets one more component, so that all have one length; the largest inner product
with a query is then the smallest distance. Blocks of vectors become trees of paged nodes: a
node keeps, for each entry, its distance to the node's own routing object and, above the
leaves, a covering radius. A search opens pages in the order of their least possible distance
and skips entries whose stored distance rules them out before their own is computed."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries of a leaf, and children of an inner node.
LEAF, FAN = 1_024, 16
#: Vectors of a tree and queries that search it in one task.
BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024
SEED = 7
#: Distances are roots of integers; this is above their rounding error.
MARGIN = 1e-6
#: Bits for the place of a row in its tree; no score.
SHIFT, NONE = 20, -(1 << 62)
#: Below this, a product fits beside a place and distances are exact enough.
SMALL = float(1 << 42)
LONG = np.iinfo(np.int64)


class MTree:
    """A tree over integer vectors. Nodes are numbered; leaves hold a range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.most = float(np.abs(self.vectors).max(initial=0.0))
        self.whole = vectors if self.most >= 2.0**53 else None  # doubles would round these
        square = (self.vectors**2).sum(axis=1)
        self.limit = float(square.max(initial=0.0))
        self.full = np.column_stack([self.vectors, np.sqrt(self.limit - square)])
        self.rng = np.random.default_rng(SEED)
        self.center: list[np.ndarray] = []  # routing object of each node
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray | None] = []
        self.to_center: list[np.ndarray] = []  # of each child's routing object, or each row
        self._build(np.arange(len(ids)))
        del self.rng, self.full

    def _distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.full[rows] - point) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray) -> int:
        center = self.full[rows].mean(axis=0) if len(rows) else np.zeros(self.full.shape[1])
        if len(rows):
            center = self.full[rows[np.argmin(self._distances(rows, center))]]
        node = len(self.center)
        far = self._distances(rows, center)
        self.center.append(center)
        self.radius.append(float(far.max(initial=0.0)))
        self.children.append(None)
        self.rows.append(rows)
        self.to_center.append(far)
        if len(rows) > LEAF:
            pivots = self.full[self.rng.choice(rows, FAN, replace=False)]
            near = ((pivots**2).sum(axis=1) - 2 * self.full[rows] @ pivots.T).argmin(axis=1)
            if np.bincount(near).max() == len(rows):  # equal vectors fill pages in any order
                near = np.arange(len(rows)) * FAN // len(rows)
            kids = np.array([self._build(rows[near == i]) for i in np.unique(near)])
            self.children[node], self.rows[node] = kids, None
            centers = np.array([self.center[k] for k in kids])
            self.to_center[node] = np.sqrt(((centers - center) ** 2).sum(axis=1))
        return node

    def _bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves, the distance of each point to their routing objects, and the least distance
        of what they hold: a page's bound holds for all pages below it."""
        centers = np.array(self.center)
        square = (points**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * points @ centers.T
        far = np.sqrt(np.maximum(square, 0.0))
        least = np.maximum(far - np.array(self.radius), 0.0)
        for node, kids in enumerate(self.children):  # a node comes before its children
            if kids is not None:
                least[:, kids] = np.maximum(least[:, kids], least[:, [node]])
        leaves = np.array([i for i, kids in enumerate(self.children) if kids is None])
        return leaves, far[:, leaves], least[:, leaves]

    def search(
        self, queries: np.ndarray, own: np.ndarray, k: int
    ) -> tuple[list[list[tuple[int, int]]], int]:
        """The k best (score, id) of each query, ties to the smaller id, without the rows whose
        id is the query's own; and how many products were computed.

        Every query opens its leaves from the nearest bound up, until the next one is beyond
        its k-th best. Queries that open the same leaf share one matrix product, in which rows
        that the stored distances rule out for all of them have no part."""
        n = len(queries)
        most = max(self.most, float(np.abs(queries.astype(np.float64)).max(initial=0.0)))
        if most * most * (queries.shape[1] + 1) >= SMALL:
            return self._search_large(queries, own, k), n * len(self.ids)
        queries = queries.astype(np.float64)
        leaves, far, least = self._bounds(np.column_stack([queries, np.zeros(n)]))
        order = np.argsort(least, axis=1, kind="stable")
        square = (queries**2).sum(axis=1)
        # Score and place among the ids in one number, so that ties are decided by it.
        place = np.empty(len(self.ids), np.int64)
        place[np.argsort(self.ids, kind="stable")[::-1]] = np.arange(len(self.ids))
        best = np.full((n, k), NONE)
        reach = np.full(n, np.inf)
        computed = 0
        for step in range(len(leaves)):
            at = order[:, step]
            live = np.flatnonzero(least[np.arange(n), at] <= reach + MARGIN)
            if not len(live):
                break
            for leaf in np.unique(at[live]):
                some = live[at[live] == leaf]
                gap = np.abs(far[some, leaf][:, None] - self.to_center[leaves[leaf]])
                use = (gap <= reach[some][:, None] + MARGIN).any(axis=0)
                rows = self.rows[leaves[leaf]][use]
                found = (queries[some] @ self.vectors[rows].T).astype(np.int64)
                computed += found.size
                found = (found << SHIFT) + place[rows]
                found[own[some][:, None] == self.ids[rows]] = NONE
                last = best[some].min(axis=1)
                row, column = np.nonzero(found > last[:, None])
                if not len(row):
                    continue
                # Only what beats a query's k-th best is merged with its best.
                row = np.concatenate([row, np.repeat(np.arange(len(some)), k)])
                value = np.concatenate([found[row[: len(column)], column], best[some].ravel()])
                order_ = np.lexsort((-value, row))
                row, value = row[order_], value[order_]
                nth = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
                best[some] = value[nth < k].reshape(len(some), k)
                last = best[some].min(axis=1)
                near = np.maximum(square[some] + self.limit - 2.0 * (last >> SHIFT), 0.0)
                reach[some] = np.where(last == NONE, np.inf, np.sqrt(near))
        by_place = np.empty(len(self.ids), np.int64)
        by_place[place] = self.ids
        best = -np.sort(-best, axis=1)
        mask = (1 << SHIFT) - 1
        return [
            [(v >> SHIFT, int(by_place[v & mask])) for v in row if v != NONE] for row in best.tolist()
        ], computed


    def _search_large(
        self, queries: np.ndarray, own: np.ndarray, k: int
    ) -> list[list[tuple[int, int]]]:
        """The same where products are too large for the distances to tell them apart: all of
        them, as 64-bit integers, or as Python's where these could overflow. Scores beyond 64
        bits count as the end of that range."""
        out = []
        most = float(np.abs(queries.astype(np.float64)).max(initial=0.0)) * self.most
        fits = most * queries.shape[1] < 2.0**62
        vectors = self.vectors.astype(np.int64) if self.whole is None else self.whole
        if not fits:
            vectors, queries = vectors.astype(object), queries.astype(object)
        for query, me in zip(queries, own):
            found = vectors @ query
            if not fits:
                found = np.clip(found, int(LONG.min), int(LONG.max)).astype(np.int64)
            order = np.lexsort((self.ids, ~found))[: k + 1]
            out.append([(int(found[i]), int(self.ids[i])) for i in order if self.ids[i] != me][:k])
        return out


def integers(vector: str) -> Column:
    """floor(64 * x) of each component; null if the vector or a component is null or not
    finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * 64).cast("long"))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def top_k(df: DataFrame, key: str, vector: str, queries: Column, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``df`` for which ``queries`` holds,
    the ``k`` other rows with the largest inner products, all if there are fewer.

    Rows without a key, and vectors that are null or hold a null or infinite component, take
    no part. A repeated key counts once, with the smallest of its vectors. Short vectors count
    as filled up with zeros. Components and scores beyond 64 bits are cut to the ends of that
    range."""
    points = (
        df.select(F.col(key).cast("long").alias("_id"), integers(vector).alias("_v"), queries.alias("_q"))
        .filter("_id is not null and _v is not null")
        .groupBy("_id").agg(F.min("_v").alias("_v"), F.max("_q").alias("_q"))
    )
    total, asking = points.agg(F.count("*"), F.count_if("_q")).first()
    blocks, parts = max(1, -(-total // BLOCK_ROWS)), max(1, -(-asking // QUERY_ROWS))

    def plant(table: pa.Table) -> pa.Table:
        lists = table.column("_v").to_pylist()
        tree = MTree(
            table.column("_id").to_numpy().astype(np.int64), _matrix(lists, max(map(len, lists)))
        )
        return pa.table(
            {"_tree": pa.array([pickle.dumps(vars(tree))], pa.binary())}
        )

    def pack(table: pa.Table) -> pa.Table:
        value = (table.column("_id").to_pylist(), table.column("_v").to_pylist())
        return pa.table({
            "_part": pa.array([table.column("_part")[0].as_py()], pa.int64()),
            "_queries": pa.array([pickle.dumps(value)], pa.binary()),
        })

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, asked in zip(batch.column(0), batch.column(1)):
                state, tree = pickle.loads(tree.as_py()), MTree.__new__(MTree)
                vars(tree).update(state)
                keys, lists = pickle.loads(asked.as_py())
                width = tree.vectors.shape[1]
                # Components beyond the longest candidate meet zeros.
                asked = _matrix([v[:width] for v in lists], width)
                found, _ = tree.search(asked, np.array(keys), k)
                out = [(own, i, s) for own, row in zip(keys, found) for s, i in row]
                a, b, c = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (a, b, c)], names=["query_id", "vec_id", "score"]
                )

    trees = (
        points.select("_id", "_v", F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("_block"))
        .groupBy("_block").applyInArrow(plant, "_tree binary")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    )
    asked = (
        points.filter("_q")
        .select("_id", "_v", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(parts)).alias("_part"))
        .groupBy("_part").applyInArrow(pack, "_part long, _queries binary")
    )
    pairs = trees.join(asked, "_part").select("_tree", "_queries").repartition(blocks * parts)
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
