"""An incremental job: new units come in as a stream, finished rows go to a
state folder, and nothing finished is asked for again.

The state is a few runs of rows. An epoch adds a run; runs of one level are merged into one of
the next when there are ``FAN`` of them, so that a row is rewritten once a level. A run is
partitioned by a hash of the id into buckets of bounded size, and a batch reads only the buckets
that its ids fall into: its cost follows the batch, not the state."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state as ST
from ..operators.staging import durable
from ..sources.state import commit, exists

#: Runs of a level that are merged; rows of a bucket; most buckets of a run (a power of two).
FAN, BUCKET_ROWS, MOST_BUCKETS = 8, 100_000, 65_536
ROW_SCHEMA = ST.STATE_SCHEMA + ", epoch bigint, bucket int"
RUN_SCHEMA = "version bigint, folder string, level int, first bigint, last bigint, buckets int"


@dataclass(frozen=True)
class Run:
    version: int
    folder: str
    level: int
    first: int
    last: int
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def runs(spark: SparkSession, folder: str, before: int | None = None) -> list[Run]:
    """Runs that count, oldest first: of an epoch that was repeated the newest, and none that a
    run of a higher level covers. ``before`` leaves out an epoch that is being repeated."""
    raw = exists(lambda: spark.read.schema(RUN_SCHEMA).json(f"{folder}/commits"))
    known = [] if raw is None else [Run(*r) for r in raw.filter("folder IS NOT NULL").collect()]
    if before is not None:
        known = [r for r in known if r.last < before]
    newest = {(r.level, r.first, r.last): r for r in sorted(known, key=lambda r: r.version)}.values()
    live = [
        r for r in newest
        if not any(o.level > r.level and o.first <= r.first and r.last <= o.last for o in newest)
    ]
    return sorted(live, key=lambda r: r.first)


def touched(spark: SparkSession, folder: str, live: list[Run], ids: DataFrame) -> list[tuple[Run, list[int]]]:
    """The buckets of each run that hold one of ``ids`` if any does. Buckets are powers of two,
    so those of the finest run tell all others."""
    most = max((r.buckets for r in live), default=1)
    found = [r[0] for r in ids.select(_bucket(most)).distinct().collect()]  # at most MOST_BUCKETS
    return [(r, sorted({b % r.buckets for b in found})) for r in live]


def _rows(spark: SparkSession, folder: str, parts: list[tuple[Run, list[int] | None]]) -> DataFrame:
    out = spark.createDataFrame([], ROW_SCHEMA)
    for run, buckets in parts:
        read = spark.read.schema(ROW_SCHEMA).parquet(f"{folder}/{run.folder}")
        if buckets is not None:
            read = read.filter(F.col("bucket").isin(buckets))  # a partition filter
        out = out.unionByName(read.select(*out.columns))
    return out


def _newest(rows: DataFrame) -> DataFrame:
    row = F.struct("file", "translation", "status", "attempts", "epoch")
    newest = rows.groupBy("id", "source_hash").agg(F.max_by(row, "epoch").alias("r"))
    return newest.select("id", "r.file", "source_hash", "r.translation", "r.status", "r.attempts", "r.epoch")


def latest_state(
    spark: SparkSession, folder: str, before: int | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """The newest row of each (id, source_hash), by a partial aggregate; with ``ids`` at least
    the rows of these."""
    live = runs(spark, folder, before)
    parts = [(r, None) for r in live] if ids is None else touched(spark, folder, live, ids)
    return _newest(_rows(spark, folder, parts)).drop("epoch")


def _add(rows: DataFrame, folder: str, level: int, first: int, last: int) -> None:
    """Write a run, then commit it: a run without its record is never read."""
    spark = rows.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    wanted = max(1, -(-rows.count() // BUCKET_ROWS))
    buckets = min(1 << (wanted - 1).bit_length(), MOST_BUCKETS)
    dealt = rows.withColumn("bucket", _bucket(buckets)).repartition("bucket")
    dealt.write.mode("error").partitionBy("bucket").parquet(f"{folder}/{name}")
    known = exists(lambda: spark.read.schema(RUN_SCHEMA).json(f"{folder}/commits"))
    newest = 0 if known is None else known.agg(F.max("version")).first()[0] or 0
    commit(spark, folder, newest, {
        "folder": name, "level": level, "first": first, "last": last, "buckets": buckets,
    })


def compact(spark: SparkSession, folder: str) -> None:
    """Merge the runs of every level that has ``FAN`` of them."""
    while True:
        live = runs(spark, folder)
        by_level: dict[int, list[Run]] = {}
        for r in live:
            by_level.setdefault(r.level, []).append(r)
        full = [v for _, v in sorted(by_level.items()) if len(v) >= FAN]
        if not full:
            return
        some = full[0]
        merged = _newest(_rows(spark, folder, [(r, None) for r in some]))
        _add(merged, folder, some[0].level + 1, some[0].first, some[-1].last)


def run_incremental(
    units: DataFrame, folder: str, checkpoint: str, translate: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Process a stream of unit rows. An epoch that is repeated after a failure takes the place
    of what it wrote before, so it leaves the same state."""

    def epoch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id", "source_hash"]).filter("translatable")
        done = latest_state(spark, folder, number, fresh).filter(F.col("status") == ST.DONE)
        open_units = fresh.join(done, ["id", "source_hash"], "left_anti")
        rows = translate(open_units).select(
            "id", "file", "source_hash", "translation", "status", "attempts",
            F.lit(number).cast("bigint").alias("epoch"),
        )
        # Counted and written: calls are not to be made twice.
        _add(durable(rows), folder, 0, number, number)
        compact(spark, folder)

    return (
        units.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
