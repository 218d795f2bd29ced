"""Everything reachable from the roots of a page, each node once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import by_page


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``edges`` has (page, parent, child), ``roots`` (page, node); the result (page, node).

    A page is a physical sheet, and what it holds is bounded, so its links are walked inside
    the task that has them: one shuffle by page, whatever the depth. The links of a page stream
    out of a sorted partition, roots first; a task holds one page. Cycles end, as a node is
    visited once; null nodes are no nodes."""
    start = F.lit(None).cast(edges.schema["parent"].dataType)
    both = roots.select("page", start.alias("parent"), F.col("node").alias("child")).unionByName(
        edges.select("page", "parent", "child").filter("parent IS NOT NULL")
    )
    both = both.filter("page IS NOT NULL AND child IS NOT NULL")
    ordered = by_page(both).sortWithinPartitions("page", F.asc_nulls_first("parent"))
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("page", "child")}

    def walk(links: dict, first: list) -> list:
        seen = dict.fromkeys(first)
        todo = list(seen)
        while todo:
            for child in links.get(todo.pop(), ()):
                if child not in seen:
                    seen[child] = None
                    todo.append(child)
        return list(seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, links, first = None, {}, []

        def frame() -> pd.DataFrame:
            found = walk(links, first)
            return pd.DataFrame({"page": [page] * len(found), "node": found})

        for pdf in batches:
            out = []
            for now, parent, child in zip(pdf["page"].tolist(), pdf["parent"].astype(object).tolist(), pdf["child"].tolist()):
                if now != page:
                    if page is not None:
                        out.append(frame())
                    page, links, first = now, {}, []
                if pd.isna(parent):
                    first.append(child)
                else:
                    links.setdefault(parent, []).append(child)
            if out:
                yield pd.concat(out)
        if page is not None:
            yield frame()

    return ordered.mapInPandas(run, f"page {kinds['page']}, node {kinds['child']}")
