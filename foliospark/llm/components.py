"""Connected components of a table of links, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (columns ``a``, ``b``, any order):
    the smallest node that can be reached.

    Large-star and small-star steps in turn: every node hands its neighbours to its smallest
    one. The number of links does not grow, a star is what remains, and the rounds end when
    the links' number and checksum stay. Each round is written to the shared folder, which cuts the lineage."""

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "links",
    )
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node go to the smallest of it and its neighbours.
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v"), "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = smallest(large)
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        edges, before = stored(small, "small-star"), now
        now = state(edges)
        if now == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
