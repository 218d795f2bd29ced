"""Markup protection: swap tags, comments and entities for numbered placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def markup_tokens(c: Column) -> Column:
    """The markup of a fragment in order; the array index is the placeholder number."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(P.MARKUP), F.lit(0))


def placeholder(i: Column) -> Column:
    return F.format_string(P.PLACEHOLDER_FORMAT, i)


def interleave(gaps: Column, items: Column) -> Column:
    """gap0 + item0 + gap1 + ...; ``gaps`` has one element more than ``items``."""
    return F.array_join(
        F.zip_with(gaps, items, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), ""
    )


def protect_markup(c: Column) -> Column:
    """P5."""
    c = F.coalesce(c, F.lit(""))
    marks = F.transform(markup_tokens(c), lambda _, i: placeholder(i))
    return interleave(F.split(c, P.MARKUP, -1), marks)


def restore_markup(c: Column, tokens: Column) -> Column:
    """Put the markup back; null unless every placeholder occurs exactly once.

    One pass over the text: split at anything shaped like a placeholder, check the
    known ones as a set, substitute, join. Unknown numbers stay as they are."""
    c = F.coalesce(c, F.lit(""))
    count = F.size(tokens)
    seen = F.regexp_extract_all(c, F.lit(P.PLACEHOLDER), F.lit(0))

    def number(mark: Column) -> Column:
        n = F.coalesce(F.regexp_extract(mark, P.PLACEHOLDER, 1).try_cast("int"), count)
        return F.when(placeholder(n) == mark, n).otherwise(count)

    used = F.filter(F.transform(seen, number), lambda n: n < count)
    exact = (F.size(used) == count) & (F.size(F.array_distinct(used)) == count)

    def original(mark: Column) -> Column:
        return F.coalesce(F.try_element_at(tokens, number(mark) + 1), mark)

    restored = interleave(F.split(c, P.PLACEHOLDER, -1), F.transform(seen, original))
    return F.when(exact, restored)


def translatable_gaps(c: Column) -> Column:
    """The text between markup that has a letter, the part worth translating."""
    gaps = F.split(F.coalesce(c, F.lit("")), P.MARKUP, -1)
    return F.filter(gaps, lambda g: g.rlike(r"\p{L}"))
