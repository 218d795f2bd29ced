"""Page layout: rows, pieces, paragraphs, ruled tables, flow.

Every operator works per page, a physical sheet with a bounded number of marks. The folds
that depend on the order of marks run over Arrow batches of pages sorted within a partition,
in time linear in the marks; the rest is plain joins, windows and aggregates. Coordinates are
of single precision throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from ..functions.geometry import (
    boundary_after,
    boundary_before,
    column_of,
    f32,
    fit_font,
    monospaced,
    overlap_ratio,
    region_contains,
    shrink_width,
    unique_floats,
    wrap_lines,
)
from .staging import bound, by_page, pinned, whole_groups

REGION = (
    "struct<x0:float,x1:float,top:float,bottom:float,verticals:array<float>,horizontals:array<float>>"
)

# --- vector marks -----------------------------------------------------------------------


def guide_lines(segments: DataFrame) -> DataFrame:
    """Long enough, straight enough segments as horizontal or vertical guides."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    horizontal = (dy <= f32(1.5)) & (dx >= f32(40))
    vertical = (dx <= f32(1.5)) & (dy >= f32(8))
    flat_y = (F.col("y1") + F.col("y2")) * f32(0.5)
    both = F.filter(
        F.array(
            F.struct(
                F.when(horizontal, "h").alias("orient"),
                F.least("x1", "x2").alias("x1"), flat_y.alias("y1"),
                F.greatest("x1", "x2").alias("x2"), flat_y.alias("y2"),
            ),
            F.struct(
                F.when(vertical, "v").alias("orient"), F.col("x1"), F.col("y1"),
                F.col("x2"), F.col("y2"),
            ),
        ),
        lambda g: g["orient"].isNotNull(),
    )
    keys = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    return segments.select(*keys, F.explode(both).alias("g")).select(*keys, "g.*")


def path_segments(ops: DataFrame) -> DataFrame:
    """Segments drawn by path operators: ``m``, ``l``, ``c`` (end point), ``re`` with
    its corner and size in (x, y, w, h), ``h`` closing, ``n`` ending a path.

    The pen and the start of the subpath are the last points set before an operator."""
    w = Window.partitionBy("page").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    op = F.col("op")
    point = F.struct("x", "y")
    nowhere = F.struct(F.lit(None).cast("float").alias("x"), F.lit(None).cast("float").alias("y"))
    start = F.last(
        F.when(op.isin("m", "re"), point).when(op == "n", nowhere), ignorenulls=True
    ).over(before)
    marked = ops.withColumn("_start", start)
    pen_after = (
        F.when(op.isin("m", "l", "c", "re"), point)
        .when(op == "h", F.coalesce(F.col("_start"), nowhere))
        .when(op == "n", nowhere)
    )
    placed = marked.withColumn("_pen", F.last(pen_after, ignorenulls=True).over(before))

    def line(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return F.struct(ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))

    x, y = F.col("x"), F.col("y")
    px, py, sx, sy = (F.col(c) for c in ("_pen.x", "_pen.y", "_start.x", "_start.y"))
    x2, y2 = x + F.col("w"), y + F.col("h")
    drawn = (
        F.when((op == "l") & px.isNotNull(), F.array(line(px, py, x, y)))
        .when((op == "h") & px.isNotNull() & sx.isNotNull(), F.array(line(px, py, sx, sy)))
        .when(
            op == "re",
            F.array(line(x, y, x2, y), line(x2, y, x2, y2), line(x2, y2, x, y2), line(x, y2, x, y)),
        )
    )
    return placed.select("page", "seq", F.explode(drawn).alias("s")).select("page", "seq", "s.*")


def image_boxes(images: DataFrame) -> DataFrame:
    """The unit square under a matrix (a b c d e f), as an upright box with the
    distance of its upper edge from the top of the page."""
    e, f = F.col("e"), F.col("f")
    xs = [e, F.col("a") + e, F.col("c") + e, F.col("a") + F.col("c") + e]
    ys = [f, F.col("b") + f, F.col("d") + f, F.col("b") + F.col("d") + f]
    boxed = images.withColumns(
        {
            "x": F.least(*xs), "y": F.least(*ys),
            "width": F.greatest(*xs) - F.least(*xs), "height": F.greatest(*ys) - F.least(*ys),
        }
    )
    return boxed.withColumn("top", F.col("page_height") - (F.col("y") + F.col("height")))


def is_filled_rect() -> Column:
    """A box of at least 8 x 4, of a plain colour."""
    big = (F.col("width") >= f32(8)) & (F.col("height") >= f32(4))
    return F.coalesce(big & ~F.col("pattern"), F.lit(False))


def filled_rects(rects: DataFrame) -> DataFrame:
    """The filled boxes."""
    return rects.filter(is_filled_rect())


def graphics_tokens(tokens: DataFrame) -> DataFrame:
    """Content-stream tokens that stay when text is removed.

    Outside a text object everything stays but the BT/ET marks. Inside one, graphics
    operators stay and take their operands with them; other operands go."""
    w = Window.partitionBy("stream").orderBy("seq")
    name = F.when(F.col("is_op"), F.col("value"))
    edge = F.when(name.isin("BT", "ET"), name)
    inside = F.coalesce(
        F.last(edge, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "BT",
        F.lit(False),
    )
    following = F.first(name, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = tokens.withColumns({"_in": inside, "_next": following})
    graphic = F.coalesce(
        F.when(F.col("is_op"), F.col("value")).otherwise(F.col("_next")).isin(*P.GRAPHICS_OPERATORS),
        F.lit(False),
    )
    mark = F.col("is_op") & F.col("value").isin("BT", "ET")
    return marked.filter(~mark & (~F.col("_in") | graphic)).drop("_in", "_next")


# --- rows and pieces ----------------------------------------------------------------------


def _floats(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(np.float32) for n in names]


def _ends(*keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys, one past the last row of its group."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cuts = np.append(np.flatnonzero(new), n)
    return cuts[np.searchsorted(cuts, np.arange(n), side="right")]


def row_numbers(glyphs: DataFrame) -> DataFrame:
    """A glyph joins the current row when its baseline is within max(2, 0.28 size)
    of the row's first glyph, in (y, x) order; otherwise it opens the next row.

    One pass over the sorted glyphs of a page: from the first glyph of a row, the next one out
    of reach is looked for in a few comparisons of arrays. Adds ``row``."""
    ordered = by_page(glyphs).sortWithinPartitions("page", "y", "x", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["page"]):
            y, size = _floats(table, "y", "size")
            reach = np.maximum(np.float32(2), size * np.float32(0.28))
            ends = _ends(table["page"].to_numpy())
            row = np.empty(len(y), np.int32)
            i, number, end = 0, 0, 0
            while i < len(y):
                number = number + 1 if i < end else 0
                end = j = ends[i]
                for low in range(i + 1, end, 128):
                    out = np.flatnonzero(y[low: min(low + 128, end)] - y[i] > reach[low: min(low + 128, end)])
                    if len(out):
                        j = low + out[0]
                        break
                row[i:j] = number
                i = j
            yield from table.append_column("row", pa.array(row)).combine_chunks().to_batches()

    return ordered.mapInArrow(run, T.StructType([*glyphs.schema.fields, T.StructField("row", T.IntegerType())]))


def _in_row() -> Window:
    return Window.partitionBy("page", "row").orderBy("x", "y", "seq")


def divider_positions(rows: DataFrame, page_width: float) -> DataFrame:
    """X positions where at least 4 wide gaps of a page line up, within 7 units.

    A gap joins the nearest position so far (the smaller of two equally near ones)
    and moves it to the midpoint; that order matters, so gaps are folded in reading
    order, one short array per page."""
    pw = f32(page_width)
    end = F.lag(F.col("x") + F.col("w")).over(_in_row())
    gaps = by_page(rows).withColumn("_end", end).select(
        "page", "row", "x", "seq", "_end", ((F.col("_end") + F.col("x")) * f32(0.5)).alias("mid")
    )
    gutter = (F.col("_end") < pw * f32(0.49)) & (F.col("x") > pw * f32(0.51))
    inside = (F.col("mid") > pw * f32(0.10)) & (F.col("mid") < pw * f32(0.90))
    wide = gaps.filter((F.col("x") - F.col("_end") >= f32(18)) & inside & ~gutter)
    per_page = wide.groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct("row", "x", "seq", "mid"))).alias("gaps")
    )
    place = "struct<g:float,n:int>"

    def step(acc: Column, gap: Column) -> Column:
        near = F.filter(acc, lambda p: F.abs(p["g"] - gap["mid"]) <= f32(7))
        hit = F.array_min(
            F.transform(
                near,
                lambda p: F.struct(
                    F.abs(p["g"] - gap["mid"]).alias("d"), p["g"].alias("g"), p["n"].alias("n")
                ),
            )
        )

        def place_gap(h: Column) -> Column:
            moved = F.struct(((h["g"] + gap["mid"]) * f32(0.5)).alias("g"), (h["n"] + 1).alias("n"))
            others = F.filter(acc, lambda p: p["g"] != h["g"])
            added = F.struct(gap["mid"].alias("g"), F.lit(1).alias("n"))
            return F.when(h.isNotNull(), F.array_append(others, moved)).otherwise(
                F.array_append(acc, added)
            )

        return bound(hit, place_gap)

    places = F.aggregate("gaps", F.array().cast(f"array<{place}>"), step)
    kept = F.transform(F.filter(places, lambda p: p["n"] >= 4), lambda p: p["g"])
    return per_page.select("page", F.sort_array(kept).alias("dividers"))


def pieces(rows: DataFrame, page_width: float, extras: DataFrame | None = None) -> DataFrame:
    """Split rows at wide gaps, at the column gutter and at dividers.

    ``extras`` has (page, region, dividers), one row per page. A divider counts from
    where the piece began, so each row is folded left to right; adds ``piece``."""
    pw = f32(page_width)
    rows = by_page(rows)
    if extras is not None:
        rows = rows.join(extras.select("page", "region", "dividers"), "page", "left")
    else:
        rows = rows.withColumns(
            {"region": F.lit(None).cast(REGION), "dividers": F.lit(None).cast("array<float>")}
        )
    ordered = rows.withColumns({
        "_top": F.col("region.top"), "_bottom": F.col("region.bottom"), "_rules": F.col("region.verticals"),
    }).drop("region").sortWithinPartitions("page", "row", "x", "y", "seq")
    kept = [c for c in rows.columns if c not in ("region", "dividers")]
    width = np.float32(page_width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, some = np.float32(0.5), np.float32(3)
        for table in whole_groups(batches, ["page", "row"]):
            x, y, w, size, top, bottom = _floats(table, "x", "y", "w", "size", "_top", "_bottom")
            ends = _ends(table["page"].to_numpy(), table["row"].to_numpy())
            # Cuts that depend on a glyph and the one before it.
            end = np.concatenate((x[:1], (x + w)[:-1]))
            gap = x - end
            gutter = (end < width * np.float32(0.49)) & (x > width * np.float32(0.51)) & (gap > np.float32(8))
            before = np.concatenate((size[:1], size[:-1]))
            cut = (gap > np.maximum(np.float32(24), before * np.float32(3.5))) | gutter
            lines = [table[c].combine_chunks() for c in ("dividers", "_rules")]
            plain = np.logical_and.reduce([
                v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == 0 for v in lines
            ])
            piece = np.zeros(len(x), np.int32)
            i = 0
            while i < len(x):
                stop = ends[i]
                if plain[i]:
                    piece[i + 1: stop] = np.cumsum(cut[i + 1: stop])
                    i = stop
                    continue
                # Cuts at lines between a glyph and the first of its piece.
                spaced, ruled = (np.array(v[i].as_py() or (), np.float32) for v in lines)
                head, number = i, 0
                while True:
                    rest = slice(head + 1, stop)
                    hit = cut[rest].copy()
                    for lines_, rule in ((spaced, False), (ruled, True)):
                        if rule and not (y[head] >= top[i] - some and y[head] <= bottom[i] + some):
                            continue
                        ahead = lines_[lines_ > x[head] + half]
                        if len(ahead):
                            passed = ahead[:, None] < x[rest][None, :] - half
                            if not rule:
                                passed &= np.abs(ahead[:, None] - end[rest][None, :]) > half
                            hit |= passed.any(axis=0)
                    at = np.flatnonzero(hit)
                    last = head + 1 + at[0] if len(at) else stop
                    piece[head:last] = number
                    if last == stop:
                        break
                    head, number = last, number + 1
                i = stop
            done = table.select(kept).append_column("piece", pa.array(piece))
            yield from done.combine_chunks().to_batches()

    fields = [f for f in rows.schema.fields if f.name in kept]
    return ordered.mapInArrow(run, T.StructType([*fields, T.StructField("piece", T.IntegerType())]))


def _word_gap(a_size: Column, b_size: Column) -> Column:
    return F.greatest(f32(0.85), F.least(f32(3.2), F.greatest(a_size, b_size) * f32(0.16)))


def lines(piece_glyphs: DataFrame) -> DataFrame:
    """One line per piece: text with word gaps, bounding box, largest size."""
    w = Window.partitionBy("page", "row", "piece").orderBy("x", "y", "seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    spaced = F.coalesce(gap > _word_gap(F.col("size"), F.lag("size").over(w)), F.lit(False))
    glyph = F.when(spaced, F.concat(F.lit(" "), F.col("u"))).otherwise(F.col("u"))
    parts = piece_glyphs.withColumn("_t", glyph)
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("x", "y", "seq", "_t"))), lambda g: g["_t"]
        ),
        "",
    )
    boxed = parts.groupBy("page", "row", "piece").agg(
        X.trim_low(text).alias("source"),
        F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"),
        F.max("size").alias("size"),
    )
    return boxed.filter(F.col("_r") > F.col("x")).select(
        "page", "row", "piece", "source", "x", "y",
        (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height"),
        F.when(F.col("size") > f32(0), F.col("size")).otherwise(f32(10)).alias("size"),
    )


# --- paragraphs ----------------------------------------------------------------------------

def paragraphs(line_rows: DataFrame, page_width: float, regions: DataFrame | None = None) -> DataFrame:
    """Merge the lines of a column into blocks.

    A line starts a block of its own when it is more than 8 below the current one, more
    than 24 beside its left edge, or across a table rule. The block grows as lines
    join, so the lines of one (page, column) are folded in (y, x) order."""
    cols = line_rows.withColumn(
        "col", column_of(F.col("x"), F.col("y"), F.col("width"), f32(page_width))
    )
    if regions is not None:
        cols = cols.join(regions.select("page", "region"), "page", "left")
    else:
        cols = cols.withColumn("region", F.lit(None).cast(REGION))
    ordered = by_page(cols.select(
        "page", "col", "y", "x", "row", "piece", "source", "width", "height", "size",
        F.col("region.top").alias("_top"), F.col("region.bottom").alias("_bottom"),
        F.col("region.verticals").alias("_v"), F.col("region.horizontals").alias("_h"),
    )).sortWithinPartitions("page", "col", "y", "x", "row", "piece")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.float32
        for table in whole_groups(batches, ["page", "col"]):
            page, col = table["page"].to_numpy(), table["col"].to_numpy()
            x, y, w, h, size, top, bottom = _floats(table, "x", "y", "width", "height", "size", "_top", "_bottom")
            ends = _ends(page, col)
            rules = [table[c].combine_chunks() for c in ("_v", "_h")]
            source = table["source"].to_pylist()
            at, texts, count, boxes = [], [], [], []
            i = 0
            while i < len(x):
                stop = ends[i]
                vert, hor = (np.array(v[i].as_py() or (), f) for v in rules)
                open_ = False
                for k in range(i, stop):
                    nx, ny = x[k], y[k]
                    fresh = not open_ or ny - ub > f(8) or abs(nx - ux) > f(24)
                    if not fresh and (len(vert) or len(hor)):
                        mid = (uy + ny) * f(0.5)
                        if top[i] - f(3) <= mid <= bottom[i] + f(3):
                            left = ux + uw
                            low, high = min(ub, ny), max(uy, ny)
                            fresh = bool(
                                (nx > left + f(1) and ((vert > left + f(1)) & (vert < nx - f(0.5))).any())
                                or ((hor > low + f(0.8)) & (hor < high - f(0.3))).any()
                            )
                    if fresh:
                        if open_:
                            boxes.append((ux, uy, uw, uh, us, ub))
                        open_ = True
                        ux, uy, uw, uh, us, ub = nx, ny, w[k], h[k], size[k], ny + h[k]
                        at.append(k)
                        texts.append([source[k]])
                        count.append(1)
                    else:
                        uw = max(ux + uw, nx + w[k]) - ux
                        uh = max(uh, ny + h[k] - uy)
                        us = min(us, size[k])
                        ub = max(ub, ny + h[k])
                        texts[-1].append(source[k])
                        count[-1] += 1
                boxes.append((ux, uy, uw, uh, us, ub))
                i = stop
            box = np.array(boxes, f).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(page[at]), pa.array(col[at]), pa.array(map(" ".join, texts), pa.string()),
                 *[pa.array(np.ascontiguousarray(c)) for c in box.T], pa.array(count, pa.int32())],
                names=["page", "col", "source", "x", "y", "width", "height", "size", "bottom", "lines"],
            )

    kinds = {c: ordered.schema[c].dataType.simpleString() for c in ("page", "col")}
    return ordered.mapInArrow(
        run, f"page {kinds['page']}, col {kinds['col']}, source string, x float, y float, width float, "
        "height float, size float, bottom float, lines int",
    )


def has_two_columns(units: DataFrame) -> DataFrame:
    """F12."""
    return units.groupBy("page").agg(
        (F.coalesce(F.bool_or(F.col("col") == 0), F.lit(False))
         & F.coalesce(F.bool_or(F.col("col") == 1), F.lit(False))).alias("two_columns")
    )


# --- ruled tables -----------------------------------------------------------------------------


def table_regions(guides: DataFrame, page_height: float) -> DataFrame:
    """At most one ruled table per page: four or more long horizontal rules of one
    span, and at least one divider between its edges.

    J12 merges nearly coincident rules in order of y, A7 picks the widest as anchor,
    F8 keeps its family, F9 the dividers that cover enough of it, P38 tidies both."""
    ph = f32(page_height)
    horizontal = (F.col("orient") == "h") & (F.col("x2") - F.col("x1") >= f32(70))
    vertical = F.col("orient") == "v"
    per_page = guides.groupBy("page").agg(
        F.sort_array(F.collect_list(F.when(horizontal, F.struct("y1", "seq", "x1", "x2")))).alias("hs"),
        F.collect_list(F.when(vertical, F.struct("x1", "x2", "y1", "y2"))).alias("vs"),
    )
    rule = "struct<y:float,x1:float,x2:float>"

    def merge(acc: Column, n: Column) -> Column:
        """(flag, rule) pairs: the first rule that fits ``n`` is flagged and widened."""
        fits = lambda g: (F.abs(g["y"] - n["y1"]) <= f32(1.5)) & (
            overlap_ratio(g["x1"], g["x2"], n["x1"], n["x2"]) >= f32(0.70)
        )
        new = F.struct(n["y1"].alias("y"), n["x1"].alias("x1"), n["x2"].alias("x2"))
        zero = F.struct(F.lit(False).alias("hit"), F.array().cast(f"array<{rule}>").alias("out"))

        def visit(seen: Column, g: Column) -> Column:
            takes = ~seen["hit"] & fits(g)
            wider = F.struct(
                g["y"].alias("y"), F.least(g["x1"], n["x1"]).alias("x1"),
                F.greatest(g["x2"], n["x2"]).alias("x2"),
            )
            return F.struct(
                (seen["hit"] | takes).alias("hit"),
                F.array_append(seen["out"], F.when(takes, wider).otherwise(g)).alias("out"),
            )

        return F.aggregate(
            acc, zero, visit,
            lambda s: F.when(s["hit"], s["out"]).otherwise(F.array_append(s["out"], new)),
        )

    length = lambda g: g["x2"] - g["x1"]
    merged = F.aggregate("hs", F.array().cast(f"array<{rule}>"), merge)
    grouped = pinned(per_page, {"g": merged}).filter(F.size("g") >= 4)
    widest = F.array_max(F.transform("g", lambda g, i: F.struct(length(g).alias("n"), (-i).alias("i"))))
    anchored = pinned(grouped, {"a": F.element_at("g", 1 - widest["i"])})
    a = F.col("a")
    family = F.filter(
        "g",
        lambda g: (F.abs(g["x1"] - a["x1"]) <= f32(6)) & (F.abs(g["x2"] - a["x2"]) <= f32(6))
        & (length(g) >= F.greatest(f32(55), length(a) * f32(0.75))),
    )
    kept = pinned(anchored, {"f": F.sort_array(family)}).filter(F.size("f") >= 4)
    kept = pinned(
        kept, {"low": F.element_at("f", 1)["y"], "high": F.element_at("f", -1)["y"]}
    )
    low, high = F.col("low"), F.col("high")

    def divides(v: Column) -> Column:
        x = (v["x1"] + v["x2"]) * f32(0.5)
        over = F.greatest(
            f32(0),
            F.least(F.greatest(v["y1"], v["y2"]), high) - F.greatest(F.least(v["y1"], v["y2"]), low),
        )
        near = (x >= a["x1"] - f32(2)) & (x <= a["x2"] + f32(2))
        long = F.hypot(v["x2"] - v["x1"], v["y2"] - v["y1"]).cast("float") >= f32(8)
        return near & long & (over > F.greatest(f32(8), (high - low) * f32(0.18)))

    inner = F.transform(F.filter("vs", divides), lambda v: (v["x1"] + v["x2"]) * f32(0.5))
    region = F.struct(
        a["x1"].alias("x0"), a["x2"].alias("x1"), (ph - high).alias("top"),
        (ph - low).alias("bottom"),
        unique_floats(F.concat(F.array(a["x1"], a["x2"]), inner), 1.5).alias("verticals"),
        unique_floats(F.transform("f", lambda g: ph - g["y"]), 1.5).alias("horizontals"),
    )
    regions = pinned(kept.select("page", "a", "f", "vs", "low", "high"), {"region": region})
    regions = regions.select("page", "region")
    return regions.filter(F.size("region.verticals") >= 3)


def assign_cells(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points inside their page's table with the cell around them."""
    r, cx, cy = F.col("region"), F.col("cx"), F.col("cy")
    inside = points.join(regions, "page").filter(region_contains(r, cx, cy))
    return inside.withColumns(
        {
            "cell_left": boundary_before(r["verticals"], cx, r["x0"]),
            "cell_right": boundary_after(r["verticals"], cx, r["x1"]),
            "cell_top": boundary_before(r["horizontals"], cy, r["top"]),
            "cell_bottom": boundary_after(r["horizontals"], cy, r["bottom"]),
        }
    )


def table_cell_units(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """The text of each table cell in its full cell box; column by table half."""
    half = f32(0.5)
    centred = glyphs.withColumns(
        {"cx": F.col("x") + F.col("w") * half, "cy": F.col("y") + F.col("h") * half}
    )
    cells = assign_cells(centred, regions).withColumns(
        {
            "kl": F.floor(F.col("cell_left") * f32(10) + half),
            "kt": F.floor(F.col("cell_top") * f32(10) + half),
        }
    )
    key = ["page", "kl", "kt"]
    w = Window.partitionBy(*key).orderBy("y", "x", "seq")
    down = F.abs(F.col("cy") - F.lag("cy").over(w)) > F.greatest(f32(2), F.col("size") * f32(0.45))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    apart = gap > _word_gap(F.col("size"), F.lag("size").over(w))
    spaced = F.coalesce(down | apart, F.lit(False))
    parts = cells.withColumn(
        "_t", F.when(spaced, F.concat(F.lit(" "), F.col("u"))).otherwise(F.col("u"))
    )
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "seq", "_t"))), lambda g: g["_t"]), ""
    )
    grouped = parts.groupBy(*key).agg(
        X.trim_low(F.regexp_replace(text, r"\s+", " ")).alias("source"),
        F.avg("cx").cast("float").alias("cx"), F.avg("cy").cast("float").alias("cy"),
        F.max("size").alias("size"), F.first("region").alias("region"),
        F.count(F.lit(1)).alias("glyphs"), F.avg("cx").alias("centre_x"),
    ).filter("source <> ''")
    r, cx, cy = F.col("region"), F.col("cx"), F.col("cy")
    left, top = boundary_before(r["verticals"], cx, r["x0"]), boundary_before(r["horizontals"], cy, r["top"])
    right = boundary_after(r["verticals"], cx, r["x1"])
    bottom = boundary_after(r["horizontals"], cy, r["bottom"])
    return grouped.select(
        "page", F.when(cx < (r["x0"] + r["x1"]) * half, 0).otherwise(1).alias("col"), "source",
        left.alias("x"), top.alias("y"), F.greatest(f32(1), right - left).alias("width"),
        F.greatest(f32(1), bottom - top).alias("height"),
        F.when(F.col("size") > f32(0), F.col("size")).otherwise(f32(8)).alias("size"),
        "glyphs", "centre_x",
    )


def layout_units(glyphs: DataFrame, guides: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Glyphs and guides of each page to ordered blocks and table cells."""
    regions = table_regions(guides, page_height)
    rows = row_numbers(glyphs)
    extras = divider_positions(rows, page_width).join(regions, "page", "full_outer")
    prose = paragraphs(lines(pieces(rows, page_width, extras)), page_width, regions)
    centre = prose.join(regions, "page", "left")
    inside = region_contains(
        F.col("region"), F.col("x") + F.col("width") * f32(0.5), F.col("y") + F.col("height") * f32(0.5)
    )
    outside = centre.filter(~F.coalesce(inside, F.lit(False))).drop("region", "bottom", "lines")
    cells = table_cell_units(glyphs, regions).drop("glyphs", "centre_x")
    units = outside.unionByName(cells)
    order = Window.partitionBy("page").orderBy("col", "y", "x", "source")
    return units.withColumn("unit", F.row_number().over(order) - 1)


# --- flow --------------------------------------------------------------------------------------


def flow_order(items: DataFrame, page_width: float) -> DataFrame:
    """Header, then left, then right column, each by distance from the top.

    Text goes by its column; an image at least half a page wide is header material."""
    pw = f32(page_width)
    image_part = (
        F.when(F.col("width") >= pw * f32(0.5), 0)
        .when(F.col("x") + F.col("width") / f32(2) < pw / f32(2), 1)
        .otherwise(2)
    )
    part = F.when(F.col("is_image"), image_part).otherwise(F.col("col") + 1)
    # text before images where both start at the same height, as they were collected
    order = Window.partitionBy("page").orderBy(
        "part", "top", F.col("is_image").cast("int"), "item"
    )
    return items.withColumn("part", part).withColumn("place", F.row_number().over(order) - 1)


def paginate(
    flow: DataFrame, page_width: float, page_height: float, margin: float = 36.0,
    text_size: float = 8.8,
) -> DataFrame:
    """Where each flow item lands: sheet number, offset from the bottom, size.

    Text takes its lines plus 4, an image its height plus 12; an item that does not fit
    opens a sheet unless the sheet is still empty. Items of a source page are folded
    in flow order."""
    pw, ph, m = f32(page_width), f32(page_height), f32(margin)
    room = F.greatest(f32(120), pw - m * f32(2))
    image_room = F.least(room, room * f32(0.88))
    leading = f32(text_size) * f32(1.22)
    full = ph - m
    item = F.struct("place", "item", "is_image", "lines", "width", "height")
    per_page = flow.groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = "struct<item:bigint,sheet:int,top:float,width:float,height:float>"
    zero = F.struct(
        F.lit(0).alias("sheet"), full.alias("top"), F.array().cast(f"array<{out}>").alias("out")
    )

    def step(acc: Column, i: Column) -> Column:
        ratio = F.greatest(
            f32(0.1),
            F.when(i["height"] > f32(0), (i["width"] / i["height"]).cast("float")).otherwise(f32(1)),
        )
        w0 = F.least(image_room, i["width"])
        h0 = (w0 / ratio).cast("float")
        text_h = i["lines"].cast("float") * leading
        needed = F.when(i["is_image"], h0 + f32(12)).otherwise(text_h + f32(4))
        turn = (acc["top"] - needed < m) & (acc["top"] < full - f32(2))
        top = F.when(turn, full).otherwise(acc["top"])
        tall = ph - m * f32(2)
        w1 = tall * ratio
        too_tall = h0 > tall
        w = F.when(too_tall, F.least(w1, room)).otherwise(w0)
        h = F.when(too_tall & (w1 > room), (room / ratio).cast("float")).when(too_tall, tall).otherwise(h0)
        height = F.when(i["is_image"], h).otherwise(text_h)
        width = F.when(i["is_image"], w).otherwise(room)
        sheet = acc["sheet"] + F.when(turn, 1).otherwise(0)
        placed = F.struct(
            i["item"].cast("bigint").alias("item"), sheet.alias("sheet"), top.alias("top"),
            width.alias("width"), height.alias("height"),
        )
        after = top - height - F.when(i["is_image"], f32(12)).otherwise(f32(4))
        return F.struct(
            sheet.alias("sheet"), after.alias("top"),
            F.array_append(acc["out"], placed).alias("out"),
        )

    placed = F.aggregate("items", zero, step, lambda a: a["out"])
    return per_page.select("page", F.explode_outer(placed).alias("p")).select("page", "p.*")


def page_plan(
    units: DataFrame, images: DataFrame, regions: DataFrame, page_height: float
) -> DataFrame:
    """K7: what to draw where when a page keeps its layout: one row per line of text.

    ``units`` has (page, unit, text, x, y, width, height, size), ``images`` (page, x,
    top, height). A unit inside the page's table takes its full cell; any other keeps its
    box, narrowed by images to its right. Returns each line with size, x and baseline
    (from the bottom edge)."""
    half = f32(0.5)
    centred = units.withColumns(
        {"cx": F.col("x") + F.col("width") * half, "cy": F.col("y") + F.col("height") * half}
    ).join(regions, "page", "left")
    r, cx, cy = F.col("region"), F.col("cx"), F.col("cy")
    cell = F.when(
        region_contains(r, cx, cy),
        F.struct(
            boundary_before(r["verticals"], cx, r["x0"]).alias("l"),
            boundary_after(r["verticals"], cx, r["x1"]).alias("r"),
            boundary_before(r["horizontals"], cy, r["top"]).alias("t"),
            boundary_after(r["horizontals"], cy, r["bottom"]).alias("b"),
            (cx >= (r["x0"] + r["x1"]) * half).alias("centred"),
        ),
    )
    placed = pinned(centred, {"cell": cell}).withColumn(
        "in_cell",
        F.coalesce(
            (F.col("cell.r") - F.col("cell.l") >= f32(12)) & (F.col("cell.b") - F.col("cell.t") >= f32(6)),
            F.lit(False),
        ),
    )
    image = F.struct("x", "top", "height")
    per_page = images.groupBy("page").agg(F.collect_list(image).alias("images"))
    none = F.array().cast("array<struct<x:float,top:float,height:float>>")
    joined = placed.join(per_page, "page", "left").withColumn("images", F.coalesce("images", none))
    pad_x, pad_y = f32(3), f32(1.2)
    safe = shrink_width(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("images"))
    cell_w = F.greatest(f32(12), F.col("cell.r") - F.col("cell.l") - pad_x * f32(2))
    cell_h = F.greatest(f32(7), F.col("cell.b") - F.col("cell.t") - pad_y * f32(2))
    clean = X.trim_low(X.sanitize_printable(F.col("text")))
    boxed = pinned(
        joined,
        {
            "clean": clean,
            "bw": F.when(F.col("in_cell"), cell_w).otherwise(F.greatest(f32(10), safe)),
            "bh": F.when(F.col("in_cell"), cell_h).otherwise(F.greatest(f32(10), F.col("height"))),
        },
    ).filter("clean <> ''")
    fit = F.when(
        F.col("in_cell"),
        fit_font(F.col("clean"), F.col("size"), F.col("bw"), F.col("bh"), 5.3, 9.2, 0.25, 1.14),
    ).otherwise(fit_font(F.col("clean"), F.col("size"), F.col("bw"), F.col("bh")))
    fitted = pinned(boxed, {"fs": fit["size"]})
    fs = F.col("fs")
    lined = pinned(fitted, {"lines": wrap_lines(F.col("clean"), fs, F.col("bw"))})
    step = fs * F.when(F.col("in_cell"), f32(1.14)).otherwise(f32(1.16))
    slack = F.greatest(f32(0), (F.col("bh") - F.size("lines").cast("float") * step) * half)
    first = F.when(F.col("in_cell"), F.col("cell.t") + pad_y + slack + fs * f32(0.78)).otherwise(
        F.col("y") + fs * f32(0.84)
    )
    rows = lined.select(
        "page", "unit", "in_cell", "fs", "x", "cell", first.alias("first"), step.alias("step"),
        F.posexplode_outer("lines").alias("line", "text"),
    )
    line_width = monospaced()(F.length("text"), fs)
    cell_x = F.when(
        F.col("cell.centred"),
        F.col("cell.l") + (F.col("cell.r") - F.col("cell.l") - line_width) * half,
    ).otherwise(F.col("cell.l") + pad_x)
    at_x = F.when(F.col("in_cell"), F.greatest(cell_x, F.col("cell.l") + half)).otherwise(F.col("x"))
    down = F.col("first") + F.col("line").cast("float") * F.col("step")
    return rows.select(
        "page", "unit", "line", "text", "in_cell", fs.alias("size"), at_x.alias("x"),
        F.greatest(f32(1), f32(page_height) - down).alias("baseline"),
    )


def text_table_regions(rows: DataFrame, dividers: DataFrame) -> DataFrame:
    """C11: a table without rules: rows that reach over a text divider by 8 on both sides,
    at least four of them; edges and dividers give the columns, row heights the rows."""
    glyph_row = rows.groupBy("page", "row").agg(
        F.min_by("y", F.struct("y", "x", "seq")).alias("y"), F.min("x").alias("lo"),
        F.max_by(F.col("x") + F.col("w"), F.struct("x", "y", "seq")).alias("hi"),
    )
    near = F.exists(
        "dividers", lambda d: (d > F.col("lo") + f32(8)) & (d < F.col("hi") - f32(8))
    )
    reached = glyph_row.join(dividers, "page").filter(near)
    per_page = reached.groupBy("page").agg(
        F.sort_array(F.collect_list("y")).alias("ys"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.first("dividers").alias("dividers"),
    ).filter(F.size("ys") >= 4)
    edges = F.concat(F.array(F.col("lo") - f32(2), F.col("hi") + f32(2)), F.col("dividers"))
    columns = pinned(per_page, {"v": unique_floats(edges, 2.0), "h": unique_floats(F.col("ys"), 5.0)})
    region = F.struct(
        F.element_at("v", 1).alias("x0"), F.element_at("v", -1).alias("x1"),
        (F.element_at("ys", 1) - f32(3)).alias("top"),
        (F.element_at("ys", -1) + f32(12)).alias("bottom"),
        F.col("v").alias("verticals"), F.col("h").alias("horizontals"),
    )
    return columns.filter(F.size("v") >= 3).select("page", region.alias("region"))
