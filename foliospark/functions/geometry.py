"""Geometry on FLOAT columns: boundaries, columns, overlap, text fitting.

Thresholds are compared in 32-bit floats, so every literal is cast; an int or a
double in an expression would widen it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sanitize_printable, trim_low

Width = Callable[[Column, Column], Column]


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def column_of(x: Column, y: Column, width: Column, page_width: Column) -> Column:
    """-1 for header and full-width material, else 0 (left) or 1 (right)."""
    right = x + width
    wide = (x < page_width * f32(0.12)) & (right > page_width * f32(0.58))
    left = x + width * f32(0.5) < page_width * f32(0.5)
    return F.when((y < f32(330)) | wide, -1).when(left, 0).otherwise(1)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two spans over the shorter of them."""
    left = F.greatest(F.least(a0, a1), F.least(b0, b1))
    right = F.least(F.greatest(a0, a1), F.greatest(b0, b1))
    shorter = F.least(F.abs(a1 - a0), F.abs(b1 - b0))
    overlap = F.greatest(f32(0), right - left)
    return F.when(shorter <= f32(0), f32(0)).otherwise((overlap / shorter).cast("float"))


def unique_floats(values: Column, tolerance: float) -> Column:
    """Sorted values; one within tolerance of the last kept moves it to the midpoint."""
    empty = F.array().cast("array<float>")

    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        far = last.isNull() | (F.abs(last - v) > f32(tolerance))
        merged = F.concat(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array((last + v) * f32(0.5)),
        )
        return F.when(far, F.array_append(acc, v)).otherwise(merged)

    return F.aggregate(F.sort_array(F.filter(values, lambda v: v.isNotNull())), empty, step)


def boundary_before(bounds: Column, at: Column, edge: Column) -> Column:
    """Last boundary not beyond ``at`` + 1, the edge when there is none."""
    return F.coalesce(
        F.try_element_at(F.filter(bounds, lambda b: b <= at + f32(1)), F.lit(-1)), edge
    )


def boundary_after(bounds: Column, at: Column, edge: Column) -> Column:
    """First boundary beyond ``at`` + 1, the edge when there is none."""
    return F.coalesce(
        F.try_element_at(F.filter(bounds, lambda b: b > at + f32(1)), F.lit(1)), edge
    )


def region_contains(region: Column, x: Column, y: Column) -> Column:
    """Point in a region, 3 units of tolerance on every side."""
    t = f32(3)
    inside = (x >= region["x0"] - t) & (x <= region["x1"] + t)
    return inside & (y >= region["top"] - t) & (y <= region["bottom"] + t)


def shrink_width(x: Column, y: Column, width: Column, height: Column, images: Column) -> Column:
    """Width left of images that overlap vertically and lie to the right."""

    def narrow(acc: Column, m: Column) -> Column:
        overlaps = (m["top"] + m["height"] > y + f32(1)) & (m["top"] < y + height - f32(1))
        room = m["x"] - x - f32(3)
        return F.when(
            overlaps & (m["x"] > x) & (room > f32(10)), F.least(acc, room)
        ).otherwise(acc)

    safe = F.aggregate(images, F.greatest(f32(10), width), narrow)
    return F.when(safe >= width - f32(0.5), width).otherwise(safe)


def monospaced(ratio: float = 0.5) -> Width:
    """Width model without fonts: every character is ``ratio`` of the size wide."""
    return lambda chars, size: chars.cast("float") * size * f32(ratio)


def wrap_lines(text: Column, size: Column, max_width: Column, width: Width = monospaced()) -> Column:
    """Greedy word wrap; an empty paragraph is an empty line."""

    def wrap_one(paragraph: Column) -> Column:
        zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

        def step(acc: Column, word: Column) -> Column:
            longer = F.when(acc["cur"] == "", word).otherwise(F.concat(acc["cur"], F.lit(" "), word))
            full = (acc["cur"] != "") & (width(F.length(longer), size) > max_width)
            return F.struct(
                F.when(full, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]).alias("out"),
                F.when(full, word).otherwise(longer).alias("cur"),
            )

        return F.aggregate(
            F.split(paragraph, r"\s+", -1), zero, step,
            lambda acc: F.array_append(acc["out"], acc["cur"]),
        )

    paragraphs = F.transform(F.split(text, r"\n+", -1), trim_low)
    return F.flatten(F.transform(paragraphs, wrap_one))


def _line_count(lengths: Column, size: Column, max_width: Column, width: Width) -> Column:
    """Lines a paragraph of word lengths takes: the same fold on numbers only."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["cur"] == 0, w).otherwise(acc["cur"] + 1 + w)
        full = (acc["cur"] > 0) & (width(longer, size) > max_width)
        return F.struct(
            (acc["n"] + F.when(full, 1).otherwise(0)).alias("n"),
            F.when(full, w).otherwise(longer).alias("cur"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: acc["n"] + 1)


def fit_font(
    text: Column, font_size: Column, box_width: Column, box_height: Column,
    low: float = 5.5, high: float = 18.0, step: float = 0.45, leading: float = 1.16,
    width: Width = monospaced(),
) -> Column:
    """Largest size, stepping down from the clamped one, whose lines fit the box.

    Returns (size, lines). The defaults are those of free units; table cells use
    5.3, 9.2, 0.25 and 1.14."""
    words = F.transform(
        F.split(trim_low(sanitize_printable(text)), r"\n+", -1),
        lambda p: F.transform(F.split(trim_low(p), r"\s+", -1), F.length),
    )
    start = F.greatest(f32(low), F.least(f32(high), font_size))

    def lines_at(size: Column) -> Column:
        return F.aggregate(
            words, F.lit(0), lambda n, p: n + _line_count(p, size, box_width, width)
        )

    def attempt(acc: Column, _: Column) -> Column:
        size = F.when(acc["lines"] == 0, start).otherwise(
            F.greatest(f32(low), acc["size"] - f32(step))
        )
        n = lines_at(size)
        fits = (n.cast("float") * (size * f32(leading)) <= box_height) | (size <= f32(low))
        return F.when(acc["done"], acc).otherwise(
            F.struct(size.alias("size"), n.alias("lines"), fits.alias("done"))
        )

    zero = F.struct(f32(0).alias("size"), F.lit(0).alias("lines"), F.lit(False).alias("done"))
    tries = int((high - low) / step) + 2
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(tries)), zero, attempt,
        lambda acc: F.struct(acc["size"].alias("size"), acc["lines"].alias("lines")),
    )
