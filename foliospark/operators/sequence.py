"""Ordered operators that stay distributed when one key holds most of the rows.

A window over a whole key would put a hot key into one task. Everything here works
on blocks of neighbouring rows instead: blocks run in parallel, and only a few
numbers per block are combined per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .staging import durable

ROWS_PER_BLOCK = 65_536


#: Most blocks that splitters make; their list stays below a megabyte at any size of the data.
MOST_BLOCKS = 65_536
LAST = np.iinfo(np.int64).max


class Even:
    """Blocks of ``span`` values each, for positions without gaps."""

    def __init__(self, span: int):
        self.span = span

    def of(self, value: Column) -> Column:
        return F.floor(value / F.lit(self.span)).cast("bigint")

    def first(self, block: int) -> int:
        return block * self.span

    def after(self, block: int) -> int:
        return (block + 1) * self.span

    def starts(self, values: np.ndarray) -> np.ndarray:
        return values % self.span == 0


class Split:
    """Blocks between splitters; what lies below the first belongs to block 0."""

    def __init__(self, edges: list[int]):
        self.edges = edges

    def of(self, value: Column) -> Column:
        if len(self.edges) == 1:
            return F.lit(0).cast("bigint")
        edges = np.array(self.edges, dtype="int64")

        @F.pandas_udf("bigint")
        def block(values: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(edges, values, side="right") - 1, 0))

        return block(value.cast("bigint"))

    def first(self, block: int) -> int:
        return self.edges[block]

    def after(self, block: int) -> int:
        return self.edges[block + 1] if block + 1 < len(self.edges) else LAST

    def starts(self, values: np.ndarray) -> np.ndarray:
        return np.isin(values, self.edges)


def splitters(df: DataFrame, order: str, rows_per_block: int = ROWS_PER_BLOCK) -> Split:
    """Blocks of about ``rows_per_block`` neighbouring rows, whatever the values look like.

    Quantiles, which a partial aggregate finds with a bounded error of rank, cut the values;
    then every block is counted, and one that is still more than twice as large as meant is cut
    again, with its values taken from its own first one, so that far and near values do not
    share one scale. Only rows of one single value stay together."""
    total, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    if not total:
        return Split([0])
    split = Split([int(low)])
    if total <= rows_per_block:
        return split
    values = durable(df.select(F.col(order).cast("bigint").alias("v")).filter("v IS NOT NULL"))
    target = max(rows_per_block, -(-total // MOST_BLOCKS))
    heavy = {0: (int(total), int(low), int(high))}
    while heavy:
        lows = F.create_map(*[F.lit(x).cast("bigint") for b, (_, lo, _) in heavy.items() for x in (b, lo)])
        inside = values.withColumn("b", split.of(F.col("v"))).filter(F.col("b").isin(*heavy))
        above = F.try_subtract(F.col("v"), F.element_at(lows, F.col("b")))
        # One list of quantiles serves all heavy blocks of a round; their error is a quarter block.
        parts = max(-(-n // target) for n, _, _ in heavy.values())
        marks = [i / parts for i in range(1, parts)]
        cuts = inside.groupBy("b").agg(F.percentile_approx(above, marks, 4 * parts).alias("q"))
        new = set()
        for r in cuts.collect():  # at most MOST_BLOCKS numbers
            _, lo, hi = heavy[r.b]
            q = [lo + x for x in r.q or ()]
            # A value that fills quantiles is cut off on both sides.
            new.update(v for v in [*q, *(v + 1 for v, w in zip(q, q[1:]) if v == w)] if lo < v <= hi)
        before = len(split.edges)
        split = Split(sorted({*split.edges, *new}))
        if len(split.edges) == before:
            break
        sizes = values.groupBy(split.of(F.col("v")).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        heavy = {
            r.b: (r.n, r.lo, r.hi)
            for r in sizes.filter((F.col("n") > 2 * target) & (F.col("hi") > F.col("lo"))).collect()
        }
    return split


def dense_ordinal(
    df: DataFrame, keys: list[str], order: str, out: str = "ordinal",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """0-based position of each row in its key, by the unique integer ``order``.

    Rank inside a block plus the number of rows in earlier blocks of the key; a key has at most
    ``MOST_BLOCKS`` of them."""
    blocked = df.withColumn("_blk", splitters(df, order, rows_per_block).of(F.col(order)))
    by = [*keys, "_blk"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, F.coalesce(before, F.lit(0)).alias("_before"))
    )
    placed = blocked.withColumn("_rank", rank).join(offsets, by)
    return placed.withColumn(out, F.col("_before") + F.col("_rank") - 1).drop(
        "_blk", "_rank", "_before"
    )


Arrays = dict[str, np.ndarray]


def per_group(
    df: DataFrame, by: list[str], order: list[str], fn: Callable[[Arrays], Arrays], schema: str
) -> DataFrame:
    """Grouped map over numpy columns: ``fn`` gets the rows of one group in ``order``.

    Groups stream out of a sorted partition, so a task holds one at a time, and many
    small groups cost no data frame each. Group columns must not be null."""
    ordered = df.repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Arrays] = []
        key = None

        def result() -> Arrays:
            return fn({c: np.concatenate([h[c] for h in held]) for c in held[0]})

        def frame(outs: list[Arrays]) -> pd.DataFrame:
            return pd.DataFrame({c: np.concatenate([o[c] for o in outs]) for c in outs[0]})

        for pdf in batches:
            if pdf.empty:
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            fresh = np.ones(len(pdf), dtype=bool)
            fresh[1:] = False
            for c in by:
                fresh[1:] |= cols[c][1:] != cols[c][:-1]
            starts = np.flatnonzero(fresh)
            outs = []
            for lo, hi in zip(starts, np.append(starts[1:], len(pdf))):
                k = tuple(cols[c][lo] for c in by)
                if held and k != key:
                    outs.append(result())
                    held = []
                key = k
                held.append({c: v[lo:hi] for c, v in cols.items()})
            if outs:
                yield frame(outs)
        if held:
            yield frame([result()])

    return ordered.mapInPandas(run, schema)


def _links(pos: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Next item of each item inside a block, and where the chain leaves the block."""
    nxt = np.searchsorted(pos, reach, side="left")
    n, leave = len(pos), reach.tolist()
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            leave[i] = leave[nxt[i]]
    return nxt, leave


def chain(
    items: DataFrame, key: str, pos: str, reach: str, blocks: int | Even | Split
) -> DataFrame:
    """Items on the greedy chain of each key, as (key, pos).

    The chain starts at the first item of a key; after an item it goes on with the
    first item whose ``pos`` is at least that item's ``reach``. ``pos`` and ``reach``
    are bigint, (key, pos) is unique and reach > pos. Exact for any data:

    1. each block (of so many positions, or between splitters) finds where chains through it
       may leave;
    2. each block answers where a chain entering at one of those places leaves;
    3. per key, a walk over these answers, a few rows per block, finds the real
       entries;
    4. each block follows the chain from its real entry.
    """
    # rows of a block: items carry a reach, places where a chain enters have reach 0
    cut = Even(blocks) if isinstance(blocks, int) else blocks
    block = cut.of(F.col("p")).alias("b")
    it = items.select(
        F.col(key).alias("k"), F.col(pos).cast("bigint").alias("p"),
        F.col(reach).cast("bigint").alias("r"), F.lit(True).alias("item"),
    ).select("*", block)
    it = durable(it)  # read by three of the steps
    ktype = it.schema["k"].dataType.simpleString()

    def with_entries(entries: DataFrame) -> DataFrame:
        marks = entries.select("k", F.col("e").alias("p"), F.lit(0).cast("bigint").alias("r"), F.lit(False).alias("item"))
        return it.unionByName(marks.select("*", block))

    def keyed(g: Arrays, **cols: np.ndarray) -> Arrays:
        n = len(next(iter(cols.values())))
        return {"k": np.repeat(g["k"][:1], n), **cols}

    def leaving(g: Arrays) -> Arrays:
        return keyed(g, e=np.unique(_links(g["p"], g["r"])[1]))

    exits = per_group(it, ["k", "b"], ["p"], leaving, f"k {ktype}, e bigint").distinct()

    def crossing(g: Arrays) -> Arrays:
        item = g["item"].astype(bool)
        if not item.any():
            none = np.zeros(0, dtype="int64")
            return keyed(g, e=none, x=none)
        p = g["p"][item]
        _, leave = _links(p, g["r"][item])
        first, after = cut.first(int(g["b"][0])), cut.after(int(g["b"][0]))
        e = np.unique(np.append(g["p"][~item], first))
        at = np.searchsorted(p, e, side="left")
        out = [leave[i] if i < len(p) else after for i in at]
        return keyed(g, e=e, x=np.array(out, dtype="int64"))

    nodes = per_group(
        with_entries(exits), ["k", "b"], ["p"], crossing, f"k {ktype}, e bigint, x bigint"
    )

    def walk(g: Arrays) -> Arrays:
        to = dict(zip(g["e"].tolist(), g["x"].tolist()))
        heads = g["e"][cut.starts(g["e"])]
        real, cur = [], int(heads[0])
        while True:
            if cur not in to:  # no block there: enter the next one at its start
                i = int(np.searchsorted(heads, cur, side="left"))
                if i == len(heads):
                    break
                cur = int(heads[i])
            real.append(cur)
            cur = to[cur]
        return keyed(g, e=np.array(real, dtype="int64"))

    real = per_group(nodes, ["k"], ["e"], walk, f"k {ktype}, e bigint")

    def follow(g: Arrays) -> Arrays:
        item = g["item"].astype(bool)
        p, hits = g["p"][item], []
        if len(p) and not item.all():
            nxt, _ = _links(p, g["r"][item])
            i = int(np.searchsorted(p, g["p"][~item][0], side="left"))
            while i < len(p):
                hits.append(i)
                i = int(nxt[i])
        return keyed(g, p=p[hits])

    found = per_group(with_entries(real), ["k", "b"], ["p"], follow, f"k {ktype}, p bigint")
    return found.select(F.col("k").alias(key), F.col("p").alias(pos))


def greedy_batches(
    units: DataFrame, key: str, order: str, size: Column,
    max_units: int = P.BATCH_UNITS, max_chars: int = P.BATCH_CHARS,
    overhead: int = P.UNIT_OVERHEAD, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Consecutive units of a key, packed greedily: at most ``max_units`` and at most
    ``max_chars`` of size plus ``overhead`` each; the first unit always fits.

    Returns (key, order, size, batch_no), ``batch_no`` counting from 0 per key. Where a
    batch ends depends only on the next ``max_units`` rows, so ends come from a short
    window inside a block that also sees the first rows of the following block; ``chain``
    then picks the real batch starts. Texts are read once, for their size."""
    sized = units.select(key, order, size.cast("bigint").alias("size"))
    numbered = durable(dense_ordinal(sized, [key], order, "_pos", rows_per_block))
    slim = numbered.select(key, "_pos", (F.col("size") + overhead).alias("_cost"))
    blk = F.floor(F.col("_pos") / F.lit(rows_per_block))
    ahead = (F.col("_pos") % rows_per_block < max_units - 1) & (blk > 0)
    seen = slim.withColumn(
        "_b", F.explode(F.when(ahead, F.array(blk, blk - 1)).otherwise(F.array(blk)))
    )
    nexts = F.collect_list("_cost").over(
        Window.partitionBy(key, "_b").orderBy("_pos").rowsBetween(0, max_units - 1)
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    taken = F.aggregate(
        nexts, zero,
        lambda a, c: F.when(
            a["open"] & ((a["n"] == 0) | (a["sum"] + c <= max_chars)),
            F.struct((a["sum"] + c).alias("sum"), (a["n"] + 1).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["sum"].alias("sum"), a["n"].alias("n"), F.lit(False).alias("open"))),
        lambda a: a["n"],
    )
    reach = (
        seen.withColumn("_reach", F.col("_pos") + taken)
        .filter(F.col("_b") == blk)
        .select(key, "_pos", "_reach")
    )
    starts = chain(reach, key, "_pos", "_reach", rows_per_block)
    marked = numbered.join(
        starts.withColumn("_start", F.lit(1)), [key, "_pos"], "left"
    ).withColumn("_blk", blk)
    by = [key, "_blk"]
    inside = F.sum(F.coalesce("_start", F.lit(0))).over(
        Window.partitionBy(*by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = F.sum("_n").over(
        Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        marked.groupBy(*by).agg(F.sum(F.coalesce("_start", F.lit(0))).alias("_n"))
        .select(*by, F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    )
    placed = marked.withColumn("_in", inside).join(offsets, by)
    return placed.withColumn("batch_no", F.col("_earlier") + F.col("_in") - 1).drop(
        "_pos", "_start", "_blk", "_in", "_earlier"
    )
