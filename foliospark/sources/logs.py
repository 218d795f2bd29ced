"""Append-only diagnostic log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_log, short_id
from ..operators.sequence import dense_ordinal


def log_lines(events: DataFrame, order: str) -> DataFrame:
    """``ts #seq stage message`` with seq counting from 1 in ``order``."""
    numbered = dense_ordinal(events, [], order, "_seq")
    line = F.concat_ws(
        " ",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
        F.concat(F.lit("#"), (F.col("_seq") + 1).cast("string")),
        safe_log(F.col("stage")),
        safe_log(F.col("message")),
    )
    return numbered.withColumn("line", line).withColumnRenamed("_seq", "seq")


def unit_message(columns: dict[str, str]) -> Column:
    """K5: ``key=value`` fields of a unit event; ids are cut, source text is never logged."""
    parts = []
    for name, column in columns.items():
        value = short_id(F.col(column)) if name == "unit" else safe_log(F.col(column).cast("string"))
        parts.append(F.concat(F.lit(f"{name}="), value))
    return F.concat_ws(" ", *parts)


def append_log(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)
