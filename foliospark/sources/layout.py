"""Page layout relations as written by an external extractor.

Decoding a PDF needs a library of its own; its output is read here with a fixed
schema (S8 glyphs, S9 path operators, S10 image matrices)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "glyphs": "page bigint, seq bigint, u string, x float, y float, w float, h float, size float",
    "paths": "page bigint, seq bigint, op string, x float, y float, w float, h float",
    "images": "page bigint, seq bigint, a float, b float, c float, d float, e float, f float, page_height float",
}


def read_marks(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    marks = spark.read.schema(SCHEMAS[kind]).format(fmt).load(path)
    return marks.filter("u IS NOT NULL AND u <> ''") if kind == "glyphs" else marks
