"""Compute once, use often."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results stay columns.

    Catalyst pushes a filter through a projection by copying the projected expression
    into it, and into every place that uses it; with folds over arrays that multiplies
    the work. A one-row outer explode is a boundary it does not cross."""
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    held = df.select(*kept, F.explode_outer(F.array(row)).alias("_pin"))
    return held.select(*kept, *[F.col(f"_pin.{n}").alias(n) for n in columns])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside a lambda that would
    otherwise repeat it for every element it looks at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def by_page(df: DataFrame) -> DataFrame:
    """Hash by page into the session's number of shuffle partitions.

    Folding a page costs far more than its bytes suggest, and adaptive execution merges
    partitions by their bytes; a given number is left as it is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "page")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of ``keys``; only the last group of a
    batch is held back for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = [batch[k][batch.num_rows - 1] for k in keys]
        marks = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        same = np.logical_and.reduce([m == v.as_py() for m, v in zip(marks, last)])
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or [held[-1][k][held[-1].num_rows - 1] for k in keys] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Only a local session without the setting
    gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder of the session. The result survives
    a lost executor and is not computed again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
