"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects at a time.
SLICE_BYTES = 4_000_000


def slices(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has about ``limit`` bytes of ``text`` or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = pc.cumulative_sum(
            pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
        ).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(int((ends <= base + limit).sum()), start + 1)
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def fold(key: str, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.getCheckpointDir() is not None:
            return context.getCheckpointDir()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage is cut and
    the rows survive a lost executor."""
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key; rows with a null key are left out
    where there are more."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share))
