"""Texts whose sets of word shingles overlap by three quarters, and their components.

A set has a bitmap of its shingles' classes, of two bits or more for each shingle; what one
bitmap has and another has not bounds what the sets share.

1. A set's shingles are ordered by hash, after those that are frequent in a sample. Two sets that overlap enough share one of their first
   quarter (prefix filter), so only those are shuffled, and only those that two sets share are
   kept. Equal sets count as one.
2. Neighbours in the order of size within a shingle are compared first: near copies become
   components, and most shingles then hold one component only. Where they do not, neighbours of
   different components in other orders are compared, in rounds, as long as these find enough.
3. In all other shingles' groups, signature trees (pages with OR-ed bitmaps and size ranges)
   are traversed pairwise; pairs of pages that cannot overlap enough are pruned, and the pairs
   of sets that are left are verified.

A link inside a component that is known already adds nothing to the result and is not looked
for; no link between two components is lost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import sample, slices, stored
from .components import components

#: The least overlap, as a fraction of the union.
NUMERATOR, DENOMINATOR = 3, 4
#: Bits of the trees' bitmaps; those of single sets are folded to it. Both are powers of two.
BITS, MOST_BITS = 1024, 1 << 15
#: Shingles of many sets come last in every set's order: those that at least so many sets of a
#: sample hold, and the most frequent ones of them. The order changes no result.
SAMPLE_ROWS, OFTEN, MOST_FREQUENT = 20_000, 6, 50_000
#: Orders in which neighbours are looked for in a round, and the share of the links of the first
#: round that a round has to find for another one to follow. They change the work, not the result.
ORDERS, WORTH = 8, 0.2
#: Bytes of text whose shingles are looked at together.
SLICE = 1_000_000
#: Pairs of pages that are looked at together.
PAIRS = 250_000
#: Keys of texts to be verified that are sent to the tasks; more are shuffled.
BROADCAST_KEYS = 1_000_000
#: Sets of a leaf and children of an inner node of a tree.
PAGE = 8
#: Sets of one shingle that a task compares with as many others.
BLOCK_ROWS = 4_096


def enough(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with so much in common overlap by three quarters."""
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes alone allow it."""
    return DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)


def _names(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each set: equal sets have equal ones. 63 bits of a digest of the hashes."""
    import xxhash

    bounds = zip(starts[:-1].tolist(), starts[1:].tolist())
    return np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes()) >> 1 for a, b in bounds], np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """Two bits or more for each shingle, ``BITS`` at least."""
    width = min(max(BITS, 1 << (2 * len(h)).bit_length()), MOST_BITS)
    flags = np.zeros(width, bool)
    flags[(h % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """A bitmap over fewer classes, ``size`` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def may_link(n: int, bits: bytes, m: int, other: bytes) -> bool:
    """Whether two sets can overlap enough: a class that only one of them has is a shingle that
    only it has."""
    size = min(len(bits), len(other))
    x, y = fold(bits, size), fold(other, size)
    alone_x = int(np.bitwise_count(x & ~y).sum())
    alone_y = int(np.bitwise_count(y & ~x).sum())
    shared = min(n - alone_x, m - alone_y)
    return DENOMINATOR * shared >= NUMERATOR * (n + m - shared)


def describe(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_shingles, set, bits)`` per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            h, starts = shingles.sets(batch.column(1))
            own = [bitmap(h[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts)), pa.array(_names(h, starts)), pa.array(own, pa.binary())],
                names=[key, "n_shingles", "set", "bits"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_shingles long, set long, bits binary")


def frequent(df: DataFrame, key: str, text: str) -> np.ndarray:
    """Shingles of many sets of a sample, ordered by hash; ``MOST_FREQUENT`` at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in slices(batches, text, SLICE):
            h, starts = shingles.sets(batch.column(0))
            names = _names(h, starts)
            new = np.zeros(len(names), bool)
            for i, name in enumerate(names.tolist()):
                new[i] = name not in sent
                sent.add(name)
            new, names = np.repeat(new, np.diff(starts)), np.repeat(names, np.diff(starts))
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(names[new])], names=["h", "set"])

    rows = sample(df, key, SAMPLE_ROWS).select(text).mapInArrow(run, "h long, set long")
    # Few shingles are frequent; equal sets count once. A sketch for each shingle would take half
    # a kilobyte, and nearly all shingles stand in one set; one shuffle serves both groupings.
    counted = rows.repartition("h").distinct().groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= OFTEN)
    found = [r.h for r in counted.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def shared_prefixes(df: DataFrame, text: str, late: np.ndarray) -> DataFrame:
    """``(h, n, set)``: prefix shingles that at least two sets hold, with the sets' sizes,
    ordered within its files by shingle, size and set. A task sends a set once."""

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in slices(batches, text, SLICE):
            h, starts = shingles.sets(batch.column(0))
            names, size = _names(h, starts), np.diff(starts)
            if len(late):
                last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                h = h[np.lexsort((h, last, np.repeat(np.arange(len(size)), size)))]
            new = np.zeros(len(size), bool)
            for i, name in enumerate(names.tolist()):
                if size[i] and name not in sent:
                    sent.add(name)
                    new[i] = True
            if len(sent) > 500_000:  # of equal sets that are sent twice, one is dropped below
                sent.clear()
            count = np.where(new, size - -(-NUMERATOR * size // DENOMINATOR) + 1, 0)
            owner = np.repeat(np.arange(len(size)), count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at].view(np.int64)), pa.array(size[owner].astype(np.int32)), pa.array(names[owner])],
                names=["h", "n", "set"],
            )

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, written = None, False  # the last row, and whether its shingle's rows are kept
        for batch in batches:
            h, n, s = (batch.column(i).to_numpy() for i in range(3))
            if not len(h):
                continue
            if held is not None:
                h, n, s = (np.concatenate(([x], y)) for x, y in zip(held, (h, n, s)))
            same = h[1:] == h[:-1]
            other = same & (s[1:] != s[:-1])
            group = np.cumsum(np.concatenate(([0], ~same)))
            many = np.bincount(group, weights=np.concatenate(([0], other))) > 0
            # Rows of equal sets lie side by side: all but the first of them go.
            out = np.concatenate(([True], ~same | other))
            if written:
                many[0], out[0] = True, False
            out &= many[group]
            held, written = (h[-1], n[-1], s[-1]), bool(many[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[out]), pa.array(n[out]), pa.array(s[out])], names=["h", "n", "set"]
            )

    rows = df.select(text).mapInArrow(prefixes, "h long, n int, set long")
    ordered = rows.repartition("h").sortWithinPartitions("h", "n", "set")
    return ordered.mapInArrow(repeated, "h long, n int, set long")


def neighbours(shared: DataFrame) -> DataFrame:
    """Distinct pairs of sets that follow each other in a shingle's order of size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, s = (batch.column(i).to_numpy() for i in range(3))
            if len(h) < 2:
                continue
            ok = (h[1:] == h[:-1]) & (s[1:] != s[:-1]) & near(n[1:].astype(np.int64), n[:-1].astype(np.int64))
            pair = np.unique(np.stack([s[:-1][ok], s[1:][ok]]).reshape(2, -1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pair], names=["a", "b"])

    pairs = shared.select("h", "n", "set").mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _several(groups: DataFrame) -> DataFrame:
    """The rows of shingles that hold more than one component."""
    mixed = groups.groupBy("h").agg(F.min("part").alias("_x"), F.max("part").alias("_y")).filter("_x <> _y")
    return groups.join(mixed.select("h"), "h")


def strangers(groups: DataFrame, number: int) -> DataFrame:
    """Distinct pairs of sets of different components that follow each other in a shingle, in
    one of ``ORDERS`` orders, others in each round."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, s, part = (batch.column(i).to_numpy() for i in range(4))
            if len(h) < 2:
                continue
            ok = (h[1:] == h[:-1]) & (part[1:] != part[:-1]) & near(n[1:].astype(np.int64), n[:-1].astype(np.int64))
            pair = np.unique(np.stack([s[:-1][ok], s[1:][ok]]).reshape(2, -1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pair], names=["a", "b"])

    place = F.xxhash64("set", F.pmod("h", F.lit(ORDERS)), F.lit(number))
    ordered = groups.select("h", "n", "set", "part", place.alias("_o")).repartition("h").sortWithinPartitions("h", "_o")
    pairs = ordered.drop("_o").mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets do overlap by three quarters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b", SLICE):
            left, ls = shingles.sets(batch.column(2))
            right, rs = shingles.sets(batch.column(3))
            shared = np.array([
                len(np.intersect1d(left[ls[i] : ls[i + 1]], right[rs[i] : rs[i + 1]], assume_unique=True))
                for i in range(batch.num_rows)
            ], np.int64)
            yield batch.filter(pa.array(enough(np.diff(ls), np.diff(rs), shared))).select(["a", "b"])

    left = texts.select(F.col("set").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose bitmaps allow enough overlap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")))
            keep = [may_link(*r) for r in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = bits.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = bits.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return both.mapInArrow(run, "a long, b long")


class SignatureTree:
    """Sets in pages, by size, then component; a node has the range of sizes of what it holds,
    the OR of the bitmaps and the least number of bits that one of them has."""

    def __init__(self, sets: np.ndarray, sizes: np.ndarray, parts: np.ndarray, bits: np.ndarray):
        order = np.lexsort((sets, parts, sizes))
        self.sets, self.parts = sets[order], parts[order]
        bits = bits[order]
        # Levels from the leaves' entries upwards; a node at i covers i * PAGE to (i + 1) * PAGE.
        self.low, self.high = [sizes[order]], [sizes[order]]
        self.bits, self.least = [bits], [np.bitwise_count(bits).sum(axis=1).astype(np.int64)]
        self.one = [self.parts.copy()]  # the component if all are of one, else -1
        while len(self.low[-1]) > 1:
            cuts = np.arange(0, len(self.low[-1]), PAGE)
            self.low.append(np.minimum.reduceat(self.low[-1], cuts))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts))
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cuts, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], cuts))
            a, b = np.minimum.reduceat(self.one[-1], cuts), np.maximum.reduceat(self.one[-1], cuts)
            self.one.append(np.where(a == b, a, -1))


def possible(x: SignatureTree, y: SignatureTree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether nodes i of x and j of y may hold sets of two components that overlap enough.

    A set of node i has at least ``least - common`` bits that no set of node j has, so at most
    ``size - (least - common)`` shingles of it are shared."""
    one = (x.one[level][i] == y.one[level][j]) & (x.one[level][i] != -1)
    xl, xh, yl, yh = x.low[level][i], x.high[level][i], y.low[level][j], y.high[level][j]
    fits = (DENOMINATOR * yh >= NUMERATOR * xl) & (DENOMINATOR * xh >= NUMERATOR * yl)
    common = np.bitwise_count(x.bits[level][i] & y.bits[level][j]).sum(axis=1).astype(np.int64)
    most = np.minimum(
        xh - np.maximum(x.least[level][i] - common, 0), yh - np.maximum(y.least[level][j] - common, 0)
    )
    # For the smallest sizes in the nodes the least is asked of what they share.
    return ~one & fits & enough(xl, yl, np.minimum(most, np.minimum(xh, yh)))


def candidates(x: SignatureTree, y: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that the traversal from both roots leaves. ``x`` may be ``y``."""
    own = x is y
    level = max(len(x.low), len(y.low)) - 1
    for t in (x, y):
        while len(t.low) <= level:  # a lower tree gets roots above its root
            for part in (t.low, t.high, t.bits, t.least, t.one):
                part.append(part[-1])
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        parts = np.array_split(np.arange(len(i)), len(i) // PAIRS + 1)
        ok = np.concatenate([possible(x, y, level, i[p], j[p]) for p in parts])
        i, j = i[ok], j[ok]
        if level == 0 or not len(i):
            break
        level -= 1
        nx, ny = len(x.low[level]), len(y.low[level])
        fx = 1 if nx == len(x.low[level + 1]) == 1 else PAGE
        fy = 1 if ny == len(y.low[level + 1]) == 1 else PAGE
        i = (i[:, None, None] * fx + np.arange(fx)[None, :, None] + np.zeros((1, 1, fy), np.int64)).ravel()
        j = (j[:, None, None] * fy + np.arange(fy)[None, None, :] + np.zeros((1, fx, 1), np.int64)).ravel()
        keep = (i < nx) & (j < ny)
        if own:
            keep &= i <= j
        i, j = i[keep], j[keep]
    if own:
        i, j = i[i < j], j[i < j]
    return x.sets[i], y.sets[j]


def tree_pairs(groups: DataFrame, bits: DataFrame) -> DataFrame:
    """Candidate pairs of sets in different components, from ``(h, n, set, part)``.

    A shingle of more than ``BLOCK_ROWS`` sets is cut into blocks, and each pair of its blocks
    is a group of its own, so that no task holds more than two blocks."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        sets = table.column("set").to_numpy()
        n, part = table.column("n").to_numpy().astype(np.int64), table.column("part").to_numpy()
        own = dict(zip(sets.tolist(), zip(n.tolist(), table.column("bits").to_pylist())))
        raw = np.array([fold(own[s][1], BITS // 8) for s in sets.tolist()])
        trees = [SignatureTree(sets[m], n[m], part[m], raw[m]) for m in (block == b for b in np.unique(block))]
        a, b = candidates(trees[0], trees[-1])
        keep = [may_link(*own[i], *own[j]) for i, j in zip(a.tolist(), b.tolist())]
        a, b = a[np.array(keep, bool)], b[np.array(keep, bool)]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    # Of shingles that the same sets hold, one is enough.
    sizes = (
        groups.groupBy("h").agg(
            F.count("*").alias("_c"), F.min("part").alias("_x"), F.max("part").alias("_y"),
            F.bit_xor(F.xxhash64("set")).alias("_p"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("_q"),
        )
        .filter("_x <> _y").groupBy("_c", "_p", "_q").agg(F.min("h").alias("h"))
        .select("h", F.ceil(F.col("_c") / BLOCK_ROWS).cast("int").alias("_blocks"))
    )
    rows = groups.join(sizes, "h").withColumn("block", F.pmod(F.xxhash64("set"), F.col("_blocks")).cast("int"))
    # With several blocks, a block meets every other one and itself.
    meets = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "h", "n", "set", "part", "block",
        F.least("block", "_other").alias("_i"), F.greatest("block", "_other").alias("_j"),
    )
    return meets.join(bits.select("set", "bits"), "set").groupBy("h", "_i", "_j").applyInArrow(run, "a long, b long").distinct()


def linked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_shingles, component_id)`` per row: the number of distinct shingles and the
    smallest key that can be reached over links, the row's own included.

    Null texts and texts without words have no shingles and no links. Rows with a null key
    have a null component and link nothing. Rows that share a key count as one text each, and
    what links one of them links the key."""
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    rows = stored(describe(docs, "_key", "text"), "sets")
    usable = docs.filter("_key is not null")
    late = frequent(usable, "_key", "text")
    shared = stored(shared_prefixes(usable, "text", late), "shared")
    usable_rows = rows.filter("_key is not null and n_shingles > 0")
    first = usable_rows.groupBy("set").agg(
        F.min("_key").alias("_key"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")
    )
    bits = first.select("set", "n", "bits")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links. Only the texts of their sets are carried along."""
        pairs = stored(pairs, name)
        some = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        keys = first.select("set", "_key").join(some, "set")
        keys = stored(keys, f"{name}-keys")
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        # Several rows may have the key of a set.
        texts = _checked(docs.join(keys, "_key").select("set", "text"))
        texts = stored(texts.groupBy("set").agg(F.first("text").alias("text")), f"{name}-texts")
        return stored(verify(pairs, texts), f"{name}-links")

    links = confirmed(compared(neighbours(shared), bits), "near")
    known = components(links)
    groups = shared.join(known.withColumnRenamed("node", "set"), "set", "left").select(
        "h", "n", "set", F.coalesce("component", "set").alias("part")
    )
    groups = stored(_several(groups), "groups")
    number, least_links = 0, None
    while True:
        new = confirmed(compared(strangers(groups, number), bits), "more")
        count = new.count()
        if not count:
            break
        links = links.unionByName(new)
        # Only components are joined on: the links between them are few.
        name = groups.select("set", "part").distinct()
        ends = new.join(name.select(F.col("set").alias("a"), F.col("part").alias("x")), "a")
        ends = ends.join(name.select(F.col("set").alias("b"), F.col("part").alias("y")), "b")
        merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
        groups = groups.join(merged.withColumnRenamed("node", "part"), "part", "left").select(
            "h", "n", "set", F.coalesce("component", "part").alias("part")
        )
        groups = stored(_several(groups), "groups")
        least_links = WORTH * count if least_links is None else least_links
        number += 1
        if count < least_links:
            break
    more = confirmed(tree_pairs(groups, bits), "far")
    found = known
    if number or not more.isEmpty():
        found = components(links.unionByName(more))
    member = rows.join(found.withColumnRenamed("node", "set"), "set", "left").select(
        "_key", "n_shingles", F.coalesce("component", "set").alias("_c")
    )
    least = member.filter("_key is not null and n_shingles > 0").groupBy("_c").agg(F.min("_key").alias("_least"))
    return member.join(least, "_c", "left").select(
        F.col("_key").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("_key").isNotNull(), F.col("_least")))
        .otherwise(F.col("_key")).alias("component_id"),
    )


def _checked(texts: DataFrame) -> DataFrame:
    """Rows whose text has the set that they stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            h, starts = shingles.sets(batch.column(1))
            yield batch.filter(pa.array(_names(h, starts) == batch.column(0).to_numpy()))

    return texts.mapInArrow(run, "set long, text string")


def keep_first(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df``, with all their columns, but of each component only the one with the
    smallest key. Rows without words or without a key stay; of rows that share a kept key, one
    with words stays."""
    found = stored(linked(df, key, text), "linked")
    gone = stored(found.filter(F.col("component_id") < F.col(key)).select(key).distinct(), "gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    kept = df.join(gone, key, "left_anti").select(*df.columns)
    with_words = found.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    if with_words.groupBy(key).count().filter("count > 1").isEmpty():
        return kept
    words = F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & F.col(key).isNotNull()
    return kept.filter(words).dropDuplicates([key]).unionByName(kept.filter(~words))
