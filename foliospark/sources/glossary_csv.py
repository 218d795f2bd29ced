"""The terminology table as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.glossary import TERM_COLUMNS, clean_terms


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Usable terms with ``ord``, their place in all files, by the files' names: rows in the
    splits before, which is a sum over a row for each split, and place in the split. Quotes are doubled inside quoted fields; a byte-order mark, blank lines,
    one-column rows and the header are dropped."""
    schema = ", ".join(f"{c} string" for c in TERM_COLUMNS)
    raw = spark.read.schema(schema).csv(path, quote='"', escape='"', encoding="UTF-8")
    split = ["_file", "_start"]
    read = raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), *TERM_COLUMNS,
    )
    before = F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    offsets = read.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(
        *split, F.coalesce(before, F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy(*split).orderBy("_id"))
    bare = read.withColumn("_rank", rank).join(offsets, split).select(
        (F.col("_before") + F.col("_rank") - 1).alias("ord"), *TERM_COLUMNS
    )
    first = F.regexp_replace("english", "^﻿", "")
    return clean_terms(bare.withColumn("english", first).fillna("", list(TERM_COLUMNS)))


def write_glossary(terms: DataFrame, path: str) -> None:
    """Every field quoted, in glossary order; the folder must be new, so that no glossary is
    lost to a write that fails."""
    ordered = clean_terms(terms).orderBy("ord").select(*TERM_COLUMNS)
    ordered.write.mode("error").csv(path, quoteAll=True, quote='"', escape='"')
