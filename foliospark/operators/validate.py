"""Does a translation keep everything its source has?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as PR
from ..functions import text as X
from .staging import pinned


def with_reason(pairs: DataFrame, src: str, dst: str, out: str = "reason") -> DataFrame:
    """Add the first rule a (source, translation) pair breaks, null when it is complete.

    Row-local: no shuffle. Intermediate values are columns of their own so that each
    is computed once. ``<out>_covered`` and ``<out>_total`` give the token coverage."""
    staged = (
        pairs.withColumns(
            {"_s": X.strip_markup(F.col(src)), "_d": X.strip_markup(F.coalesce(dst, F.lit("")))}
        )
        .withColumns(
            {
                "_sl": X.utf16_length(F.col("_s")),
                "_dl": X.utf16_length(F.col("_d")),
                "_sn": X.sentence_count(F.col("_s")),
                "_dn": X.sentence_count(F.col("_d")),
                "_need": X.important_tokens(F.col("_s")),
                "_have": X.important_tokens(F.col("_d")),
                "_head": PR.heading_violation(F.col("_s"), F.col("_d")),
            }
        )
        .withColumns(
            {
                f"{out}_total": F.size("_need"),
                f"{out}_covered": X.multiset_cover(F.col("_need"), F.col("_have")),
            }
        )
    )
    total, covered = F.col(f"{out}_total"), F.col(f"{out}_covered")
    required = F.greatest(F.lit(1), F.ceil(total * F.lit(0.75)).cast("int"))
    short = (F.col("_sl") >= 80) & (
        F.col("_dl") < F.greatest(F.lit(20.0), F.col("_sl") * F.lit(0.30))
    )
    reason: Column = (
        F.when(X.is_blank(F.col(dst)), P.REASON_BLANK)
        .when(F.col("_sl") < 2, None)
        .when(F.col("_dl") == 0, P.REASON_INVISIBLE)
        .when(short, P.REASON_SHORT)
        .when(
            (F.col("_sn") >= 3) & (F.col("_dn") < F.col("_sn") - 1),
            F.format_string(P.REASON_SENTENCES, "_sn", "_dn"),
        )
        .when(
            (total > 0) & (covered < required), F.format_string(P.REASON_TOKENS, covered, total)
        )
        .when(F.col("_head").isNotNull(), F.format_string(P.REASON_HEADING, "_head"))
    )
    return pinned(staged, {out: reason}).drop(
        "_s", "_d", "_sl", "_dl", "_sn", "_dn", "_need", "_have", "_head"
    )
