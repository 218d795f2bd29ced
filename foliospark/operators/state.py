"""Saved progress keyed on (id, source_hash): recover, find pending, merge, summarize."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .validate import with_reason

DONE, SOURCE_ONLY = "DONE", "SOURCE_ONLY"
STATE_SCHEMA = (
    "id string, file string, source_hash string, translation string, status string, attempts int"
)


def recover(units: DataFrame, state: DataFrame) -> DataFrame:
    """Units with their saved translation where it is current and complete.

    Joining on the content hash makes a stale row invisible. Only key and text of
    the state travel."""
    saved = state.select("id", "source_hash", "translation").filter(
        ~X.is_blank(F.col("translation"))
    )
    joined = with_reason(units.join(saved, ["id", "source_hash"], "left"), "inner", "translation")
    done = F.col("translation").isNotNull() & F.col("reason").isNull()
    return joined.withColumns(
        {"done": done, "translation": F.when(done, F.col("translation"))}
    ).drop("reason", "reason_total", "reason_covered")


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """Translatable units with no finished row; runs before any translator call."""
    return units.filter("translatable").join(done.select("id"), "id", "left_anti")


def merge(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """K3: keyed upsert, the new row wins as a whole. Applying it twice changes nothing."""
    values = [c for c in old.columns if c not in keys]
    right = new.select(
        *keys, F.struct(*[F.col(c) for c in values]).alias("_n")
    )
    left = old.select(*keys, F.struct(*[F.col(c) for c in values]).alias("_o"))
    picked = left.join(right, list(keys), "full_outer").select(
        *keys, F.coalesce("_n", "_o").alias("_v")
    )
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def manifest(units: DataFrame, state: DataFrame, book: str) -> DataFrame:
    """Totals per book, with the summary line.

    Counts are aggregated on each side before they meet."""
    total = units.groupBy(book).agg(F.count_if("translatable").alias("total_units"))
    saved = state.groupBy(book).agg(
        F.count_if(F.col("status") == DONE).alias("completed_units"),
        F.count(F.lit(1)).alias("state_rows"),
    )
    joined = total.join(saved, book, "left").select(
        book,
        F.lit(3).alias("version"),
        "total_units",
        F.coalesce("completed_units", F.lit(0)).cast("bigint").alias("completed_units"),
        F.coalesce("state_rows", F.lit(0)).cast("bigint").alias("state_rows"),
    )
    done, all_ = F.col("completed_units"), F.col("total_units")
    return joined.withColumns(
        {
            "percent": X.progress_percent(done, all_),
            "summary": F.format_string("Đã dịch %d/%d unit", done, all_),
        }
    )


def missing_ids(expected: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Expected ids the answers do not have."""
    return expected.join(answered.select(*keys), keys, "left_anti")


def first_unfinished(pages: DataFrame, book: str) -> DataFrame:
    """First page with no text that is not marked as failed."""
    open_page = X.is_blank(F.col("text")) & ~F.col("failed")
    return pages.groupBy(book).agg(
        F.coalesce(F.min(F.when(open_page, F.col("page"))), F.lit(-1)).alias("first_unfinished"),
        F.count_if("failed").alias("failed_pages"),
        F.count_if(~F.col("failed") & ~X.is_blank(F.col("text"))).alias("finished_pages"),
    )
