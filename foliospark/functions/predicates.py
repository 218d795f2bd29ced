"""Which fragments are worth translating, and which saved answers are usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X


# Two to ten letters, digits and dashes in all, whatever lies between them, the
# first a letter. Anchored and possessive: it gives up at the eleventh.
_SKIP = "[^A-Za-z0-9-]*+"
SHORT_CODE = f"^{_SKIP}[A-Za-z](?:{_SKIP}[A-Za-z0-9-]){{1,9}}+{_SKIP}$"


def attributes_denied(attrs: Column) -> Column:
    """A deny-listed word in attributes that hold no line break."""
    a = F.lower(F.coalesce(attrs, F.lit("")))
    word = P.WORD_BEFORE + "(?:" + "|".join(P.DENIED_ATTRIBUTE_WORDS) + ")" + P.WORD_AFTER
    return a.rlike(word) & ~a.rlike(r"[\n\r\x{85}\x{2028}\x{2029}]")


def is_short_heading(plain: Column) -> Column:
    low = F.lower(X.trim_low(plain))
    return low.isin(*P.SHORT_HEADINGS) | low.rlike(P.NUMBERED_TABLE)


def should_translate(attrs: Column, plain: Column) -> Column:
    """F1. ``plain`` is the stripped text; cheap tests come first."""
    long_enough = (F.length(plain) >= 2) | (F.octet_length(plain) >= 4)
    code = plain.rlike(SHORT_CODE)
    already = X.has_vietnamese(plain) & (
        X.english_words(plain) < F.greatest(F.lit(3), X.vietnamese_words(plain) * 2)
    )
    return (
        long_enough
        & plain.rlike(r"\p{L}")
        & ~attributes_denied(attrs)
        & ~(code & ~is_short_heading(plain))
        & ~already
    )


def heading_violation(src: Column, dst: Column) -> Column:
    """Label of a known heading whose required rendering is missing, else null."""
    s, low = F.lower(src), F.lower(dst)
    label = F.lit(None).cast("string")
    for word, accepted in P.HEADING_EXACT.items():
        label = F.when((s == word) & ~low.isin(*accepted), P.HEADING_LABEL[word]).otherwise(label)
    for word, needed in P.HEADING_CONTAINS.items():
        bad = (s == word) & ~F.contains(low, F.lit(needed))
        label = F.when(bad, P.HEADING_LABEL[word]).otherwise(label)
    return label
