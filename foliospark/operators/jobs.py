"""Whole jobs: a book from its content files and saved state to new files and new state, and
pages in slices that are committed one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..sources import state as SS
from . import profile as PR
from . import sequence as SQ
from . import state as ST
from . import translate as TR
from . import units as U
from .staging import checkpoint_folder, durable

# Files of a slice at most, so that several tasks write and read it.
SLICE_FILES = 8


def book_job(
    files: DataFrame, saved: DataFrame, translator: TR.Translator, in_flight: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Content files (file, html) and saved state to (file, content, misplaced) and the
    state to save.

    Units whose saved translation is current and complete are kept; the others are asked for
    in batches by file, then one by one as far as needed, and a unit that no step translates
    keeps its source. ``in_flight`` bounds the calls running at once. Of repeated saved rows
    of an id one counts, the one with the greatest translation."""
    units = durable(U.extract_units(files, "file", "html").filter("translatable"))
    row = F.struct("translation", "file", "source_hash", "status", "attempts")
    once = saved.groupBy("id").agg(F.max(row).alias("r")).select(
        "id", "r.file", "r.source_hash", "r.translation", "r.status", "r.attempts"
    )
    done = durable(ST.recover(units, once).filter("done"))
    todo = durable(ST.pending(units, done))
    batches = SQ.greedy_batches(todo, "file", "ordinal", X.utf16_length(F.col("inner")))
    batched = todo.join(batches.drop("size"), ["file", "ordinal"])
    candidates = TR.batch_candidates(batched, ["file", "batch_no"], translator, in_flight=in_flight)
    new = TR.translate_units(todo, translator, candidates, in_flight=in_flight)
    new = durable(new)
    place = ["file", "ordinal", "translation"]
    texts = done.select(*place).unionByName(new.filter("status = 'DONE'").select(*place))
    state = ST.merge(once, new.select(*once.columns))
    return U.rebuild(files, "file", "html", texts), state


def page_job(
    units: DataFrame, path: str, translator: TR.Translator, pages_per_slice: int = 1_000,
    slices: int | None = None, in_flight: int | None = None,
) -> DataFrame:
    """Units (file, page, unit, source) to saved pages (file, page, text,
    failed), resumable.

    A file with a page that has no text at all ends the job before any call is made. Pages that
    ``path`` holds as finished in the current layout are not asked for again; the others go
    through the page recovery in slices, in order of file and page, and a slice is committed as
    a version of its own when it is done, so that a run that dies loses one slice at most.
    ``slices`` ends a run early. Failed pages keep their source, are marked, and are asked for
    again by the next run. The units of all slices are first put into a folder for each slice,
    beside the checkpoints, so that a slice reads its own and not all units again."""
    spark = units.sparkSession
    some_text = F.bool_or(~X.is_blank(F.col("source")))
    texts = durable(units.groupBy("file", "page").agg(F.when(some_text, "text").alias("text")))
    PR.require_text_layer(PR.page_text_profile(texts, "file", "text")).agg(F.count("*")).collect()
    finished = SS.read_pages(spark, path).filter(~F.col("failed") & ~X.is_blank(F.col("text")))
    todo = texts.select("file", "page").join(finished, ["file", "page"], "left_anti")
    numbered = durable(_numbered(todo, ["file", "page"], "_place"))
    total = numbered.count()
    wanted = -(-total // pages_per_slice)
    wanted = wanted if slices is None else min(slices, wanted)
    part = numbered.withColumn("_slice", F.floor(F.col("_place") / pages_per_slice).cast("int"))
    part = part.filter(F.col("_slice") < wanted).select("file", "page", "_slice")
    folder = f"{checkpoint_folder(spark)}/page-slices-{uuid.uuid4().hex}"
    some = units.join(part, ["file", "page"])
    dealt = some.repartition("_slice", F.pmod(F.xxhash64("file", "page"), F.lit(SLICE_FILES)))
    dealt.write.partitionBy("_slice").parquet(folder)
    for n in range(wanted):
        rows = spark.read.schema(some.drop("_slice").schema).parquet(f"{folder}/_slice={n}")
        pages = TR.translate_pages(
            rows.withColumn("page", F.struct("file", "page")), translator, in_flight=in_flight
        )
        SS.write_pages(
            pages.select("page.file", "page.page", "text", "failed", F.lit(P.LAYOUT_VERSION).alias("layout_version")),
            path, whole=False,
        )
    return SS.read_pages(spark, path)


def _numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0: sorted ranges, the place in the range and
    the rows in the ranges before, which is a sum over one row for each range."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = durable(ranges.withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(before, F.lit(0)).alias("_before")
    )
    placed = ranges.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(out, F.col("_before") + inside).select(*rows.columns, out)
