"""Document profiles: one row of counts per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

COUNTED_TAGS = ("p", "figure", "table", "img")


def tag_count(html: Column, tag: str) -> Column:
    """Opening tags of one name; works on markup that is not well formed."""
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}(?=[\s/>])"))


def markup_profile(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """A1: files and p / figure / table / img counts. One partial aggregation."""
    counts = [
        F.sum(tag_count(F.col(html), t).cast("bigint")).alias(f"{t}_count") for t in COUNTED_TAGS
    ]
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), *counts)


def page_text_profile(pages: DataFrame, book: str, text: str) -> DataFrame:
    """Pages with and without a text layer; a book is accepted when
    every page has one."""
    has_text = ~X.is_blank(F.col(text))
    return pages.groupBy(F.col(book).alias("title")).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(has_text).alias("text_pages"),
        F.count_if(~has_text).alias("empty_pages"),
        F.bool_and(has_text).alias("accepted"),
    )


def require_text_layer(profile: DataFrame) -> DataFrame:
    """S7 as a hard check: the job fails at the first book with an empty page."""
    return profile.filter(
        F.when(F.col("accepted"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("no text layer: "), F.col("title"))).cast("boolean")
        )
    )
