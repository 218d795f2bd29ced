"""Saved progress on storage: JSON rows, page state, manifest; in committed versions, so that a
write that dies at any point loses nothing.

A folder of versions holds ``data/<name>``, one folder for each write, and ``commits/<number>``,
one record for each version. A version is there once its record is: the rows are written by a
job of their own first, and whatever that job leaves behind when it dies is never read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.state import STATE_SCHEMA

PAGE_SCHEMA = "file string, page bigint, text string, failed boolean, layout_version string"
COMMIT_SCHEMA = "version bigint, folder string, whole boolean"


def exists(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None if its folder is not there; any other error is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def commits(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(version, folder, whole) of every version, oldest first. A record without content is a
    writer's that died on it. The list is one short row for each write since the last cleanup."""
    raw = exists(lambda: spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits"))
    if raw is None:
        return []
    rows = raw.filter("version IS NOT NULL AND folder IS NOT NULL").collect()
    return sorted((r.version, r.folder, bool(r.whole)) for r in rows)


def commit(spark: SparkSession, path: str, last: int, record: dict) -> int:
    """Write ``record`` under the next free number after ``last``. A record is created only where
    there is none, so that of two writers with the same number one goes on to the next."""
    number = last
    hadoop = spark._jvm.org.apache.hadoop.fs
    while True:
        number += 1
        place = hadoop.Path(f"{path}/commits/{number:012d}.json")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            out = files.create(place, False)
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception):
                raise
            continue
        out.write(bytearray(json.dumps({"version": number, **record}), "utf-8"))
        out.close()
        return number


def publish(df: DataFrame, path: str, whole: bool = True) -> int:
    """Write ``df`` as the next version in ``path`` and return its number. ``whole``: it takes
    the place of all before it; otherwise its rows are added to theirs."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.mode("error").json(f"{path}/{folder}")
    known = commits(df.sparkSession, path)
    last = known[-1][0] if known else 0
    return commit(df.sparkSession, path, last, {"folder": folder, "whole": whole})


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the newest whole version and of all that were added to it, with ``version``. A
    folder without versions counts as one, of number 0."""
    known = commits(spark, path)
    if not known:
        rows = exists(lambda: spark.read.schema(schema).json(path, columnNameOfCorruptRecord="_corrupt_record"))
        rows = spark.createDataFrame([], schema) if rows is None else rows
        return rows.withColumn("version", F.lit(0).cast("bigint"))
    start = max((i for i, c in enumerate(known) if c[2]), default=0)
    out = None
    for number, folder, _ in known[start:]:
        read = spark.read.schema(schema).json(f"{path}/{folder}", columnNameOfCorruptRecord="_corrupt_record")
        read = read.withColumn("version", F.lit(number).cast("bigint"))
        out = read if out is None else out.unionByName(read)
    return out


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Saved unit rows of the newest version; a corrupt row is dropped, missing fields
    get defaults."""
    raw = latest(spark, path, f"{STATE_SCHEMA}, _corrupt_record string").drop("version")
    good = raw.filter("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")
    return good.fillna({"file": "", "translation": "", "status": "DONE", "attempts": 0})


def write_state(state: DataFrame, path: str) -> int:
    """K3: publish a new version of the state."""
    return publish(state, path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, of each the row of its newest version, as the current layout sees
    them."""
    raw = latest(spark, path, PAGE_SCHEMA).filter("page IS NOT NULL")
    row = F.struct("version", "text", "failed", "layout_version")
    newest = raw.groupBy("file", "page").agg(F.max(row).alias("r"))
    return current_pages(newest.select("file", "page", "r.text", "r.failed", "r.layout_version"))


def write_pages(pages: DataFrame, path: str, whole: bool = True) -> int:
    """K9: publish text, failure and layout version of every page, or (``whole=False``) of
    some, beside what is there."""
    return publish(pages.select("file", "page", "text", "failed", "layout_version"), path, whole)


def current_pages(saved: DataFrame, version: str = P.LAYOUT_VERSION) -> DataFrame:
    """Page rows of the current layout version; others count as not translated."""
    current = F.col("layout_version") == version
    return saved.withColumns(
        {
            "text": F.when(current, F.col("text")).otherwise(""),
            "failed": F.coalesce(current & F.col("failed"), F.lit(False)),
        }
    )


def write_manifest(manifest: DataFrame, path: str) -> int:
    """K4."""
    return publish(manifest.withColumn("updated_at", F.current_timestamp()), path)
