"""Layout operators over marks derived from events, line items and embeddings.

A page is a run of consecutive event ids, so its number of marks is bounded whatever
the other columns look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.geometry import f32
from ..operators import layout as L
from . import sqltext as S
from .registry import query, spread, table

PAGE_WIDTH, PAGE_HEIGHT = 560.0, 792.0

GLYPH = {
    "page": "event_id DIV 256",
    "seq": "event_id",
    "u": "left(event_type, 1)",
    "x": "CAST(36 + (user_id * 7 + event_id * 13) % 520 + 0.5 * (event_id % 2) AS FLOAT)",
    "y": "CAST(200 + 14 * (user_id % 24) + 0.75 * (event_id % 5) AS FLOAT)",
    "w": "CAST(4 + event_id % 6 AS FLOAT)",
    "h": "CAST(7 + user_id % 8 AS FLOAT)",
    "size": "CAST(7 + user_id % 8 AS FLOAT)",
}
GUIDE = {
    "page": "event_id DIV 256",
    "seq": "event_id",
    "orient": "CASE WHEN event_id % 8 = 0 THEN 'h' ELSE 'v' END",
    "x1": "CAST(CASE WHEN event_id % 8 = 0 THEN 60 + user_id % 3 ELSE 60 + 100 * (user_id % 5) END AS FLOAT)",
    "y1": "CAST(CASE WHEN event_id % 8 = 0 THEN 240 + 25 * (user_id % 9) + 0.5 * (user_id % 2) ELSE 240 END AS FLOAT)",
    "x2": "CAST(CASE WHEN event_id % 8 = 0 THEN 300 + 160 * least(1, user_id % 4) + user_id % 5"
          " ELSE 60 + 100 * (user_id % 5) END AS FLOAT)",
    "y2": "CAST(CASE WHEN event_id % 8 = 0 THEN 240 + 25 * (user_id % 9) + 0.5 * (user_id % 2)"
          " ELSE 250 + 10 * (user_id % 20) END AS FLOAT)",
}


def _cols(fields: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('DIV', '//')} AS {n}" for n, e in fields.items())


def derive(spark: SparkSession, d: str, source: str, fields: dict[str, str], where: str = "true") -> DataFrame:
    rows = table(spark, d, source).filter(where)
    return rows.select(*[F.expr(e.replace("DIV", "div")).alias(n) for n, e in fields.items()])


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "events", GLYPH)


def guides(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "events", GUIDE)


SEGMENT = {
    "page": "l_orderkey DIV 32",
    "seq": "l_orderkey * 10 + l_linenumber",
    "x1": "CAST(l_quantity * 8 AS FLOAT)",
    "y1": "CAST(l_suppkey % 700 AS FLOAT)",
    "x2": "CAST(l_quantity * 8 AS FLOAT) + CAST((l_partkey % 90 - 45) * least(1, l_linenumber % 3) AS FLOAT)",
    "y2": "CAST(l_suppkey % 700 AS FLOAT) + CAST((l_partkey % 31 - 15) * least(1, l_linenumber % 2) AS FLOAT)",
}


@query(
    "guide_lines", "S9,D15",
    f"""WITH s AS (SELECT {_cols(SEGMENT)} FROM lineitem)
        SELECT page, seq, 'h' AS orient, least(x1, x2)::DOUBLE AS x1, ((y1 + y2) * 0.5::FLOAT)::DOUBLE AS y1,
               greatest(x1, x2)::DOUBLE AS x2, ((y1 + y2) * 0.5::FLOAT)::DOUBLE AS y2
        FROM s WHERE abs(y2 - y1) <= 1.5 AND abs(x2 - x1) >= 40
        UNION ALL
        SELECT page, seq, 'v', x1::DOUBLE, y1::DOUBLE, x2::DOUBLE, y2::DOUBLE FROM s WHERE abs(x2 - x1) <= 1.5 AND abs(y2 - y1) >= 8""",
)
def guide_lines(spark: SparkSession, d: str) -> DataFrame:
    found = L.guide_lines(derive(spark, d, "lineitem", SEGMENT))
    return found.select(
        "page", "seq", "orient", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    )


PATH_OP = {
    "page": "event_id DIV 256",
    "seq": "event_id",
    "op": "CASE event_id % 11 WHEN 0 THEN 'm' WHEN 4 THEN 'c' WHEN 6 THEN 'h' WHEN 8 THEN 're' WHEN 10 THEN 'n' ELSE 'l' END",
    "x": "CAST(user_id AS FLOAT)",
    "y": "CAST(value AS FLOAT)",
    "w": "CAST(user_id % 50 AS FLOAT)",
    "h": "CAST(event_id % 40 AS FLOAT)",
}


@query(
    "path_segments", "S9",
    f"""WITH RECURSIVE o AS (SELECT {_cols(PATH_OP)}, row_number() OVER (PARTITION BY event_id // 256 ORDER BY event_id) AS rn FROM events),
        w AS (SELECT page, rn, seq, op, x, y, w, h, NULL::FLOAT AS px, NULL::FLOAT AS py, NULL::FLOAT AS sx, NULL::FLOAT AS sy,
                     CASE WHEN op IN ('m', 'l', 'c', 're') THEN x END AS nx, CASE WHEN op IN ('m', 'l', 'c', 're') THEN y END AS ny,
                     CASE WHEN op IN ('m', 're') THEN x END AS nsx, CASE WHEN op IN ('m', 're') THEN y END AS nsy FROM o WHERE rn = 1
              UNION ALL
              SELECT o.page, o.rn, o.seq, o.op, o.x, o.y, o.w, o.h, w.nx, w.ny, w.nsx, w.nsy,
                     CASE WHEN o.op IN ('m', 'l', 'c', 're') THEN o.x WHEN o.op = 'h' THEN w.nsx WHEN o.op = 'n' THEN NULL ELSE w.nx END,
                     CASE WHEN o.op IN ('m', 'l', 'c', 're') THEN o.y WHEN o.op = 'h' THEN w.nsy WHEN o.op = 'n' THEN NULL ELSE w.ny END,
                     CASE WHEN o.op IN ('m', 're') THEN o.x WHEN o.op = 'n' THEN NULL ELSE w.nsx END,
                     CASE WHEN o.op IN ('m', 're') THEN o.y WHEN o.op = 'n' THEN NULL ELSE w.nsy END
              FROM w JOIN o ON o.page = w.page AND o.rn = w.rn + 1),
        s AS (SELECT page, seq, px AS x1, py AS y1, x AS x2, y AS y2 FROM w WHERE op = 'l' AND px IS NOT NULL
              UNION ALL SELECT page, seq, px, py, sx, sy FROM w WHERE op = 'h' AND px IS NOT NULL AND sx IS NOT NULL
              UNION ALL SELECT page, seq, x, y, x + w, y FROM w WHERE op = 're' UNION ALL SELECT page, seq, x + w, y, x + w, y + h FROM w WHERE op = 're'
              UNION ALL SELECT page, seq, x + w, y + h, x, y + h FROM w WHERE op = 're' UNION ALL SELECT page, seq, x, y + h, x, y FROM w WHERE op = 're')
        SELECT page, seq, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM s""",
)
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    found = L.path_segments(derive(spark, d, "events", PATH_OP))
    return found.select("page", "seq", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])


#: A vector of 64 values makes eleven matrices of six, one after the other; the last one goes on
#: at the beginning.
_MATRIX_SQL = ", ".join(
    f"(embedding[(image * 6 + {i}) % 64 + 1] * {100 if i < 4 else 500})::FLOAT AS {c}" for i, c in enumerate("abcdef")
)


@query(
    "image_boxes", "S10,S11,D17",
    f"""WITH i AS (SELECT vec_id, image, {_MATRIX_SQL}, label FROM (SELECT *, unnest(range(0, 11))::INTEGER AS image FROM embeddings)),
       m AS (SELECT vec_id, image, label, least(e, a + e, c + e, a + c + e) AS x, least(f, b + f, d + f, b + d + f) AS y,
                    greatest(e, a + e, c + e, a + c + e) - least(e, a + e, c + e, a + c + e) AS width,
                    greatest(f, b + f, d + f, b + d + f) - least(f, b + f, d + f, b + d + f) AS height FROM i)
       SELECT vec_id, image, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height,
              (792::FLOAT - (y + height))::DOUBLE AS top, width >= 8 AND height >= 4 AND label % 2 = 0 AS filled FROM m""",
)
def image_boxes(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(10))))
    at = lambda i, k: (F.get("embedding", (F.col("image") * 6 + i) % 64) * f32(k)).cast("float")
    images = vectors.select(
        "vec_id", "image", (F.col("label") % 2 == 1).alias("pattern"), f32(PAGE_HEIGHT).alias("page_height"),
        *[at(i, 100 if i < 4 else 500).alias(c) for i, c in enumerate("abcdef")],
    )
    return L.image_boxes(images).select(
        "vec_id", "image", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height", "top")],
        L.is_filled_rect().alias("filled"),
    )


TOKEN = {
    "stream": "event_id DIV 128",
    "seq": "event_id",
    "is_op": "event_type <> 'click'",
    "value": "CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR(9)) ELSE CASE user_id % 9 WHEN 0 THEN 'BT' WHEN 1 THEN 'ET'"
             " WHEN 2 THEN 'Tj' WHEN 3 THEN 'cs' WHEN 4 THEN 'Tf' WHEN 5 THEN 'scn' WHEN 6 THEN 'Do' WHEN 7 THEN 'TJ' ELSE 'f*' END END",
}


@query(
    "bt_et_filter", "F10,W10",
    f"""WITH t AS (SELECT {_cols(TOKEN)} FROM events),
        m AS (SELECT *, coalesce(last_value(CASE WHEN is_op AND value IN ('BT', 'ET') THEN value END IGNORE NULLS) OVER
                   (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ET') = 'BT' AS inside,
                first_value(CASE WHEN is_op THEN value END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t)
        SELECT stream, seq, value FROM m WHERE NOT (is_op AND value IN ('BT', 'ET'))
          AND (NOT inside OR coalesce(CASE WHEN is_op THEN value ELSE nxt END, '') IN ('cs', 'scn', 'Do', 'f*'))""",
)
def bt_et_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.graphics_tokens(derive(spark, d, "events", TOKEN)).select("stream", "seq", "value")


# --- rows, pieces, paragraphs --------------------------------------------------------------

_SQL_ROWS = f"""gl AS (SELECT {_cols(GLYPH)} FROM events),
    go AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, seq) AS rn FROM gl),
    rw AS (SELECT page, rn, seq, 0 AS row, y AS at FROM go WHERE rn = 1
           UNION ALL
           SELECT o.page, o.rn, o.seq, CASE WHEN o.y - r.at > greatest(2::FLOAT, o.size * 0.28::FLOAT) THEN r.row + 1 ELSE r.row END,
                  CASE WHEN o.y - r.at > greatest(2::FLOAT, o.size * 0.28::FLOAT) THEN o.y ELSE r.at END
           FROM rw r JOIN go o ON o.page = r.page AND o.rn = r.rn + 1),
    rws AS (SELECT gl.*, rw.row, row_number() OVER (PARTITION BY gl.page, rw.row ORDER BY x, y, gl.seq) AS k FROM gl JOIN rw USING (page, seq))"""

_SQL_DIVIDERS = """gp AS (SELECT page, row, x, seq, lag(x + w) OVER (PARTITION BY page, row ORDER BY k) AS e FROM rws),
    gm AS (SELECT *, (e + x) * 0.5::FLOAT AS mid FROM gp),
    wide AS (SELECT * FROM gm WHERE x - e >= 18 AND mid > 560::FLOAT * 0.10::FLOAT AND mid < 560::FLOAT * 0.90::FLOAT
             AND NOT (e < 560::FLOAT * 0.49::FLOAT AND x > 560::FLOAT * 0.51::FLOAT)),
    gl2 AS (SELECT page, list([{'g': mid, 'n': 1}] ORDER BY row, x, seq) AS l FROM wide GROUP BY page),
    dv AS (SELECT page, list_sort(list_transform(list_filter(list_reduce(l, lambda acc, s:
             CASE WHEN len(list_filter(acc, lambda p: abs(p.g - s[1].g) <= 7::FLOAT)) = 0 THEN acc || s
             ELSE list_filter(acc, lambda p: p.g <> list_sort(list_transform(list_filter(acc, lambda p: abs(p.g - s[1].g) <= 7::FLOAT), lambda p: {'d': abs(p.g - s[1].g), 'g': p.g}))[1].g)
                  || [{'g': (list_sort(list_transform(list_filter(acc, lambda p: abs(p.g - s[1].g) <= 7::FLOAT), lambda p: {'d': abs(p.g - s[1].g), 'g': p.g}))[1].g + s[1].g) * 0.5::FLOAT,
                       'n': list_sort(list_transform(list_filter(acc, lambda p: abs(p.g - s[1].g) <= 7::FLOAT), lambda p: {'d': abs(p.g - s[1].g), 'g': p.g, 'n': p.n}))[1].n + 1}] END),
             lambda p: p.n >= 4), lambda p: p.g)) AS dividers FROM gl2)"""

def _sql_pieces(regions: bool = False) -> str:
    """Row splitting; with ``regions`` a table divider splits as well."""
    extra, source, ruled = "", "", ""
    if regions:
        extra = ", coalesce(r.verticals, []::FLOAT[]) AS vt, r.top AS rt, r.bottom AS rb"
        source = " LEFT JOIN regions r ON r.page = rws.page"
        ruled = """
                    OR (coalesce(p.hy >= r.rt - 3::FLOAT AND p.hy <= r.rb + 3::FLOAT, false)
                        AND len(list_filter(r.vt, lambda g: g > p.hx + 0.5::FLOAT AND g < r.x - 0.5::FLOAT)) > 0)"""
    return f"""rd AS (SELECT rws.*, coalesce(dividers, []::FLOAT[]) AS dividers{extra} FROM rws LEFT JOIN dv ON dv.page = rws.page{source}),
    pc AS (SELECT page, row, k, seq, 0 AS piece, x AS hx, y AS hy, x AS px, w AS pw, size AS ps FROM rd WHERE k = 1
           UNION ALL
           SELECT page, row, k, seq, CASE WHEN cut THEN piece + 1 ELSE piece END, CASE WHEN cut THEN x ELSE hx END,
                  CASE WHEN cut THEN y ELSE hy END, x, w, size FROM (
             SELECT r.page, r.row, r.k, r.seq, r.x, r.y, r.w, r.size, p.piece, p.hx, p.hy, (r.x - (p.px + p.pw) > greatest(24::FLOAT, p.ps * 3.5::FLOAT)
                    OR (p.px + p.pw < 560::FLOAT * 0.49::FLOAT AND r.x > 560::FLOAT * 0.51::FLOAT AND r.x - (p.px + p.pw) > 8)
                    OR len(list_filter(r.dividers, lambda g: g > p.hx + 0.5::FLOAT AND g < r.x - 0.5::FLOAT AND abs(g - (p.px + p.pw)) > 0.5::FLOAT)) > 0{ruled}) AS cut
             FROM pc p JOIN rd r ON r.page = p.page AND r.row = p.row AND r.k = p.k + 1)),
    pg AS (SELECT rws.*, pc.piece FROM rws JOIN pc USING (page, row, k)),
    pt AS (SELECT *, x - lag(x + w) OVER w > greatest(0.85::FLOAT, least(3.2::FLOAT, greatest(size, lag(size) OVER w) * 0.16::FLOAT)) AS sp
           FROM pg WINDOW w AS (PARTITION BY page, row, piece ORDER BY k)),
    ln AS (SELECT page, row, piece, trim(string_agg(CASE WHEN sp THEN ' ' ELSE '' END || u, '' ORDER BY k)) AS source, min(x) AS x, min(y) AS y,
                  max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, max(size) AS size
           FROM pt GROUP BY page, row, piece)"""


@query(
    "row_cluster", "W4,L3,D13",
    f"WITH RECURSIVE {_SQL_ROWS} SELECT page, seq, row::INTEGER AS row FROM rw",
)
def row_cluster(spark: SparkSession, d: str) -> DataFrame:
    return L.row_numbers(glyphs(spark, d)).select("page", "seq", "row")


@query(
    "divider_positions", "C10,A9,W8",
    f"WITH RECURSIVE {_SQL_ROWS}, {_SQL_DIVIDERS} SELECT page, g::DOUBLE AS divider FROM (SELECT page, unnest(dividers) AS g FROM dv)",
)
def divider_positions(spark: SparkSession, d: str) -> DataFrame:
    found = L.divider_positions(L.row_numbers(glyphs(spark, d)), PAGE_WIDTH)
    flat = found.select("page", F.explode_outer("dividers").alias("g")).filter("g IS NOT NULL")
    return flat.select("page", F.col("g").cast("double").alias("divider"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = L.row_numbers(glyphs(spark, d))
    extras = L.divider_positions(rows, PAGE_WIDTH).withColumn("region", F.lit(None).cast(L.REGION))
    return L.lines(L.pieces(rows, PAGE_WIDTH, extras))


_BOX = ("x", "y", "width", "height", "size")
_SQL_BOX = ", ".join(f"{c}::DOUBLE AS {c}" for c in _BOX)


@query(
    "line_pieces", "W5,W6,D14,J13,A5,A11",
    f"""WITH RECURSIVE {_SQL_ROWS}, {_SQL_DIVIDERS}, {_sql_pieces()}
        SELECT page, row::INTEGER AS row, piece::INTEGER AS piece, source, {_SQL_BOX} FROM ln""",
)
def line_pieces(spark: SparkSession, d: str) -> DataFrame:
    return page_lines(spark, d).select(
        "page", "row", "piece", "source", *[F.col(c).cast("double").alias(c) for c in _BOX]
    )


def _sql_paragraphs(regions: bool = False) -> str:
    """Block merging; with ``regions`` a table rule between two lines separates them."""
    extra, source, ruled = "", "", ""
    if regions:
        extra = ", coalesce(r.verticals, []::FLOAT[]) AS vt, coalesce(r.horizontals, []::FLOAT[]) AS hz, r.top AS rt, r.bottom AS rb"
        source = " LEFT JOIN regions r ON r.page = lc.page"
        ruled = """
                        OR (coalesce((p.uy + l.y) * 0.5::FLOAT >= l.rt - 3::FLOAT AND (p.uy + l.y) * 0.5::FLOAT <= l.rb + 3::FLOAT, false) AND (
                            (l.x > p.ux + p.uw + 1::FLOAT AND len(list_filter(l.vt, lambda g: g > p.ux + p.uw + 1::FLOAT AND g < l.x - 0.5::FLOAT)) > 0)
                            OR len(list_filter(l.hz, lambda h: h > least(p.ub, l.y) + 0.8::FLOAT AND h < greatest(p.uy, l.y) - 0.3::FLOAT)) > 0))"""
    return f"""lc AS (SELECT *, CASE WHEN y < 330 OR (x < 560::FLOAT * 0.12::FLOAT AND x + width > 560::FLOAT * 0.58::FLOAT) THEN -1
                  WHEN x + width * 0.5::FLOAT < 560::FLOAT * 0.5::FLOAT THEN 0 ELSE 1 END AS col FROM ln),
    lo AS (SELECT lc.*{extra}, row_number() OVER (PARTITION BY lc.page, col ORDER BY y, x, row, piece) AS rn FROM lc{source}),
    pm AS (SELECT page, col, rn, 0 AS unit, source, x AS ux, y AS uy, width AS uw, height AS uh, size AS us, y + height AS ub FROM lo WHERE rn = 1
           UNION ALL
           SELECT page, col, rn, CASE WHEN fresh THEN unit + 1 ELSE unit END, CASE WHEN fresh THEN ls ELSE source || ' ' || ls END,
                  CASE WHEN fresh THEN x ELSE ux END, CASE WHEN fresh THEN y ELSE uy END,
                  CASE WHEN fresh THEN width ELSE greatest(ux + uw, x + width) - ux END,
                  CASE WHEN fresh THEN height ELSE greatest(uh, y + height - uy) END,
                  CASE WHEN fresh THEN size ELSE least(us, size) END, CASE WHEN fresh THEN y + height ELSE greatest(ub, y + height) END
           FROM (SELECT l.page, l.col, l.rn, l.source AS ls, l.x, l.y, l.width, l.height, l.size, p.unit, p.source, p.ux, p.uy, p.uw, p.uh, p.us, p.ub,
                        l.y - p.ub > 8 OR abs(l.x - p.ux) > 24{ruled} AS fresh
                 FROM pm p JOIN lo l ON l.page = p.page AND l.col = p.col AND l.rn = p.rn + 1)),
    pu AS (SELECT page, col, unit, arg_max(source, rn) AS source, max(rn) - min(rn) + 1 AS lines, arg_max(ux, rn) AS x, arg_max(uy, rn) AS y,
                  arg_max(uw, rn) AS width, arg_max(uh, rn) AS height, arg_max(us, rn) AS size FROM pm GROUP BY page, col, unit)"""


@query(
    "paragraph_merge", "W7,P39,D14",
    f"""WITH RECURSIVE {_SQL_ROWS}, {_SQL_DIVIDERS}, {_sql_pieces()}, {_sql_paragraphs()}
        SELECT page, col::INTEGER AS col, source, lines::INTEGER AS lines, {_SQL_BOX} FROM pu""",
)
def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(page_lines(spark, d), PAGE_WIDTH).select(
        "page", "col", "source", "lines", *[F.col(c).cast("double").alias(c) for c in _BOX]
    )


@query(
    "two_columns", "F12",
    f"""WITH RECURSIVE {_SQL_ROWS}, {_SQL_DIVIDERS}, {_sql_pieces()}, {_sql_paragraphs()}
        SELECT page, bool_or(col = 0) AND bool_or(col = 1) AS two_columns FROM pu GROUP BY page""",
)
def two_columns(spark: SparkSession, d: str) -> DataFrame:
    return L.has_two_columns(L.paragraphs(page_lines(spark, d), PAGE_WIDTH))


# --- tables ------------------------------------------------------------------------------------

_UNIQUE = (
    "list_reduce(list_transform(list_sort({xs}), lambda v: [v]), lambda acc, v: CASE WHEN len(acc) = 0 OR"
    " abs(acc[len(acc)] - v[1]) > {tol}::FLOAT THEN acc || v ELSE acc[1:len(acc) - 1] || [(acc[len(acc)] + v[1]) * 0.5::FLOAT] END, []::FLOAT[])"
)

_SQL_REGIONS = f"""gd AS (SELECT {_cols(GUIDE)} FROM events),
    hs AS (SELECT page, list([{{'y': y1, 'x1': x1, 'x2': x2}}] ORDER BY y1, seq) AS l FROM gd WHERE orient = 'h' AND x2 - x1 >= 70 GROUP BY page),
    vs AS (SELECT page, list({{'x': (x1 + x2) * 0.5::FLOAT, 'lo': least(y1, y2), 'hi': greatest(y1, y2)}}) AS v FROM gd
           WHERE orient = 'v' AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 8 GROUP BY page),
    gg AS (SELECT page, list_reduce(l, lambda acc, s:
             CASE WHEN list_position(list_transform(acc, lambda g: abs(g.y - s[1].y) <= 1.5 AND
                  greatest(0::FLOAT, least(g.x2, s[1].x2) - greatest(g.x1, s[1].x1)) / least(g.x2 - g.x1, s[1].x2 - s[1].x1) >= 0.70::FLOAT), true) IS NULL THEN acc || s
             ELSE list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda q: abs(q.y - s[1].y) <= 1.5 AND
                  greatest(0::FLOAT, least(q.x2, s[1].x2) - greatest(q.x1, s[1].x1)) / least(q.x2 - q.x1, s[1].x2 - s[1].x1) >= 0.70::FLOAT), true)
                  THEN {{'y': g.y, 'x1': least(g.x1, s[1].x1), 'x2': greatest(g.x2, s[1].x2)}} ELSE g END) END) AS g FROM hs),
    ga AS (SELECT page, g, list_filter(g, lambda r: r.x2 - r.x1 = list_max(list_transform(g, lambda q: q.x2 - q.x1)))[1] AS a FROM gg WHERE len(g) >= 4),
    gf AS (SELECT page, a, list_sort(list_filter(g, lambda r: abs(r.x1 - a.x1) <= 6 AND abs(r.x2 - a.x2) <= 6
                  AND r.x2 - r.x1 >= greatest(55::FLOAT, (a.x2 - a.x1) * 0.75::FLOAT))) AS f FROM ga),
    gr AS (SELECT gf.*, f[1].y AS lo, f[len(f)].y AS hi, coalesce(v, []) AS v FROM gf LEFT JOIN vs USING (page) WHERE len(f) >= 4),
    gv AS (SELECT *, list_transform(list_filter(v, lambda q: q.x >= a.x1 - 2::FLOAT AND q.x <= a.x2 + 2::FLOAT
                  AND greatest(0::FLOAT, least(q.hi, hi) - greatest(q.lo, lo)) > greatest(8::FLOAT, (hi - lo) * 0.18::FLOAT)), lambda q: q.x) AS xs FROM gr),
    rg AS (SELECT page, a.x1 AS x0, a.x2 AS x1, 792::FLOAT - hi AS top, 792::FLOAT - lo AS bottom,
                  {_UNIQUE.format(xs="[a.x1, a.x2] || xs", tol=1.5)} AS verticals,
                  {_UNIQUE.format(xs="list_transform(f, lambda r: 792::FLOAT - r.y)", tol=1.5)} AS horizontals FROM gv),
    regions AS (SELECT * FROM rg WHERE len(verticals) >= 3)"""


@query(
    "table_regions", "C9,J12,A7,F8,F9,P38,D16",
    f"""WITH {_SQL_REGIONS} SELECT page, x0::DOUBLE AS x0, x1::DOUBLE AS x1, top::DOUBLE AS top, bottom::DOUBLE AS bottom,
        array_to_string(list_transform(verticals, lambda v: (v * 1000)::BIGINT), ',') AS verticals,
        array_to_string(list_transform(horizontals, lambda v: (v * 1000)::BIGINT), ',') AS horizontals FROM regions""",
)
def table_regions(spark: SparkSession, d: str) -> DataFrame:
    regions = L.table_regions(guides(spark, d), PAGE_HEIGHT).select("page", "region.*")
    mills = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * f32(1000)).cast("bigint")), ",")
    return regions.select(
        "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")],
        mills("verticals").alias("verticals"), mills("horizontals").alias("horizontals"),
    )


_SQL_CELLS = """pts AS (SELECT gl.*, x + w * 0.5::FLOAT AS cx, y + h * 0.5::FLOAT AS cy FROM gl),
    cells AS (SELECT p.*, r.x0, r.x1, r.top, r.bottom, r.verticals, r.horizontals,
              coalesce(list_filter(verticals, lambda b: b <= cx + 1::FLOAT)[-1], r.x0) AS cl, coalesce(list_filter(verticals, lambda b: b > cx + 1::FLOAT)[1], r.x1) AS cr,
              coalesce(list_filter(horizontals, lambda b: b <= cy + 1::FLOAT)[-1], r.top) AS ct, coalesce(list_filter(horizontals, lambda b: b > cy + 1::FLOAT)[1], r.bottom) AS cb
              FROM pts p JOIN regions r USING (page)
              WHERE cx >= r.x0 - 3::FLOAT AND cx <= r.x1 + 3::FLOAT AND cy >= top - 3::FLOAT AND cy <= bottom + 3::FLOAT)"""


@query(
    "cell_assign", "J8,J9,J10,L5",
    f"""WITH gl AS (SELECT {_cols(GLYPH)} FROM events), {_SQL_REGIONS}, {_SQL_CELLS}
        SELECT page, seq, cl::DOUBLE AS cell_left, cr::DOUBLE AS cell_right, ct::DOUBLE AS cell_top, cb::DOUBLE AS cell_bottom FROM cells""",
)
def cell_assign(spark: SparkSession, d: str) -> DataFrame:
    half = f32(0.5)
    points = glyphs(spark, d).withColumns(
        {"cx": F.col("x") + F.col("w") * half, "cy": F.col("y") + F.col("h") * half}
    )
    cells = L.assign_cells(points, L.table_regions(guides(spark, d), PAGE_HEIGHT))
    names = ("cell_left", "cell_right", "cell_top", "cell_bottom")
    return cells.select("page", "seq", *[F.col(c).cast("double").alias(c) for c in names])


@query(
    "table_cells", "C8,A6,A8,W6",
    f"""WITH gl AS (SELECT {_cols(GLYPH)} FROM events), {_SQL_REGIONS}, {_SQL_CELLS},
        ck AS (SELECT *, floor(cl * 10::FLOAT + 0.5::FLOAT) AS kl, floor(ct * 10::FLOAT + 0.5::FLOAT) AS kt FROM cells),
        cs AS (SELECT *, coalesce(abs(cy - lag(cy) OVER w) > greatest(2::FLOAT, size * 0.45::FLOAT)
                 OR x - lag(x + w) OVER w > greatest(0.85::FLOAT, least(3.2::FLOAT, greatest(size, lag(size) OVER w) * 0.16::FLOAT)), false) AS sp
               FROM ck WINDOW w AS (PARTITION BY page, kl, kt ORDER BY y, x, seq))
        SELECT page, regexp_replace(trim(string_agg(CASE WHEN sp THEN ' ' ELSE '' END || u, '' ORDER BY y, x, seq)), '\\s+', ' ', 'g') AS source,
               count(*)::BIGINT AS glyphs, round(avg(cx), 3) AS cx, max(size)::DOUBLE AS size FROM cs GROUP BY page, kl, kt""",
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    regions = L.table_regions(guides(spark, d), PAGE_HEIGHT)
    cells = L.table_cell_units(glyphs(spark, d), regions)
    return cells.select(
        "page", "source", "glyphs", F.round(F.col("centre_x"), 3).alias("cx"),
        F.col("size").cast("double").alias("size"),
    )


_SQL_CELL_TEXT = """ck AS (SELECT *, floor(cl * 10::FLOAT + 0.5::FLOAT) AS kl, floor(ct * 10::FLOAT + 0.5::FLOAT) AS kt FROM cells),
        cs AS (SELECT *, coalesce(abs(cy - lag(cy) OVER w) > greatest(2::FLOAT, size * 0.45::FLOAT)
                 OR x - lag(x + w) OVER w > greatest(0.85::FLOAT, least(3.2::FLOAT, greatest(size, lag(size) OVER w) * 0.16::FLOAT)), false) AS sp
               FROM ck WINDOW w AS (PARTITION BY page, kl, kt ORDER BY y, x, seq)),
        cg AS (SELECT page, kl, kt, string_agg(CASE WHEN sp THEN ' ' ELSE '' END || u, '' ORDER BY y, x, seq) AS source,
                      avg(cx)::FLOAT AS mx, avg(cy)::FLOAT AS my, max(size) AS size FROM cs GROUP BY page, kl, kt),
        cu AS (SELECT page, CASE WHEN mx < (x0 + x1) * 0.5::FLOAT THEN 0 ELSE 1 END AS col, source,
                 coalesce(list_filter(verticals, lambda b: b <= mx + 1::FLOAT)[-1], x0) AS l, coalesce(list_filter(verticals, lambda b: b > mx + 1::FLOAT)[1], x1) AS r,
                 coalesce(list_filter(horizontals, lambda b: b <= my + 1::FLOAT)[-1], top) AS t, coalesce(list_filter(horizontals, lambda b: b > my + 1::FLOAT)[1], bottom) AS b, size
               FROM cg JOIN regions USING (page)),
        lu AS (SELECT page, col, source, x, y, width, height, size FROM pu p WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.page = p.page
                 AND p.x + p.width * 0.5::FLOAT >= r.x0 - 3::FLOAT AND p.x + p.width * 0.5::FLOAT <= r.x1 + 3::FLOAT
                 AND p.y + p.height * 0.5::FLOAT >= r.top - 3::FLOAT AND p.y + p.height * 0.5::FLOAT <= r.bottom + 3::FLOAT)
               UNION ALL SELECT page, col, source, l, t, greatest(1::FLOAT, r - l), greatest(1::FLOAT, b - t), size FROM cu)"""


@query(
    "layout_units", "C7,C8,L3,D14",
    f"""WITH RECURSIVE {_SQL_ROWS}, {_SQL_DIVIDERS}, {_SQL_REGIONS}, {_sql_pieces(True)}, {_sql_paragraphs(True)}, {_SQL_CELLS}, {_SQL_CELL_TEXT}
        SELECT page, (row_number() OVER (PARTITION BY page ORDER BY col, y, x, source) - 1)::INTEGER AS unit, col::INTEGER AS col, source, {_SQL_BOX} FROM lu""",
)
def layout_units(spark: SparkSession, d: str) -> DataFrame:
    """The whole layout stage: glyphs and guides to ordered blocks and table cells."""
    units = L.layout_units(glyphs(spark, d), guides(spark, d), PAGE_WIDTH, PAGE_HEIGHT)
    return units.select("page", "unit", "col", "source", *[F.col(c).cast("double").alias(c) for c in _BOX])


@query(
    "overlap_shrink", "J11",
    f"""WITH g AS (SELECT {_cols(GLYPH)}, CAST(30 + user_id % 90 AS FLOAT) AS width FROM events),
        i AS (SELECT page, x AS ix, y AS it, CAST(40 AS FLOAT) AS ih FROM g),
        s AS (SELECT g.page, g.seq, g.width, min(i.ix - g.x - 3::FLOAT) AS room FROM g LEFT JOIN i ON i.page = g.page AND i.it + i.ih > g.y + 1::FLOAT
              AND i.it < g.y + g.h - 1::FLOAT AND i.ix > g.x AND i.ix - g.x - 3::FLOAT > 10 GROUP BY ALL)
        SELECT page, seq, (CASE WHEN least(greatest(10::FLOAT, width), coalesce(room, width)) >= width - 0.5::FLOAT THEN width
               ELSE least(width, room) END)::DOUBLE AS safe_width FROM s""",
)
def overlap_shrink(spark: SparkSession, d: str) -> DataFrame:
    units = derive(spark, d, "events", {**GLYPH, "width": "CAST(30 + user_id % 90 AS FLOAT)"})
    image = F.struct(F.col("x"), F.col("y").alias("top"), f32(40).alias("height"))
    images = units.groupBy("page").agg(F.collect_list(image).alias("images"))
    empty = F.array().cast("array<struct<x:float,top:float,height:float>>")
    joined = units.join(images, "page", "left").withColumn("images", F.coalesce("images", empty))
    safe = G.shrink_width(F.col("x"), F.col("y"), F.col("width"), F.col("h"), F.col("images"))
    return joined.select("page", "seq", safe.cast("double").alias("safe_width"))


@query(
    "tolerance_dedup", "P38,W8",
    f"""SELECT vec_id, pos::BIGINT AS pos, kept::DOUBLE AS kept FROM (SELECT vec_id, unnest(u) AS kept, generate_subscripts(u, 1) AS pos
        FROM (SELECT vec_id, {_UNIQUE.format(xs="list_transform(embedding, lambda v: (v * 100)::FLOAT)", tol=1.5)} AS u FROM embeddings))""",
)
def tolerance_dedup(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("embedding", lambda v: (v * f32(100)).cast("float"))
    kept = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode_outer(G.unique_floats(scaled, 1.5)).alias("pos", "kept")
    )
    return kept.select(
        "vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("kept").cast("double").alias("kept")
    )


@query(
    "asof_bounds", "J9,J10",
    """WITH b AS (SELECT vec_id, list_sort(list_transform(embedding, lambda v: (v * 100)::FLOAT)) AS bs, unnest(embedding) * 100::FLOAT AS v,
                         generate_subscripts(embedding, 1) AS i FROM embeddings)
       SELECT vec_id, i::BIGINT AS i, coalesce(list_filter(bs, lambda b: b <= v + 1::FLOAT)[-1], -99::FLOAT)::DOUBLE AS before,
              coalesce(list_filter(bs, lambda b: b > v + 1::FLOAT)[1], 99::FLOAT)::DOUBLE AS after FROM b""",
)
def asof_bounds(spark: SparkSession, d: str) -> DataFrame:
    hundred = lambda c: F.transform(c, lambda v: (v * f32(100)).cast("float"))
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.sort_array(hundred("embedding")).alias("bs"),
        F.posexplode_outer(hundred("embedding")).alias("i", "v"),
    )
    return rows.select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("i"),
        G.boundary_before(F.col("bs"), F.col("v"), f32(-99)).cast("double").alias("before"),
        G.boundary_after(F.col("bs"), F.col("v"), f32(99)).cast("double").alias("after"),
    )


@query(
    "overlap_ratio", "P37",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT) AS a0, CAST(l_quantity + l_suppkey % 9 AS FLOAT) AS a1,
                         CAST(l_quantity + 3 AS FLOAT) AS b0, CAST(l_quantity + 3 + l_partkey % 7 - 3 AS FLOAT) AS b1 FROM lineitem)
       SELECT l_orderkey, l_linenumber, (CASE WHEN least(abs(a1 - a0), abs(b1 - b0)) <= 0 THEN 0 ELSE
              greatest(0::FLOAT, least(greatest(a0, a1), greatest(b0, b1)) - greatest(least(a0, a1), least(b0, b1))) / least(abs(a1 - a0), abs(b1 - b0)) END)::FLOAT::DOUBLE AS ratio FROM s""",
)
def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    ratio = G.overlap_ratio(
        f32(q), f32(q + F.col("l_suppkey") % 9), f32(q + 3), f32(q + 3 + F.col("l_partkey") % 7 - 3)
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", ratio.cast("double").alias("ratio")
    )


@query(
    "bbox_agg", "A5,A6,A7",
    f"""WITH g AS (SELECT {_cols(GLYPH)} FROM events)
        SELECT page, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x + w)::DOUBLE AS x1, max(y + h)::DOUBLE AS y1, max(size)::DOUBLE AS max_size,
               min(size)::DOUBLE AS min_size, round(avg(x + w * 0.5::FLOAT), 3) AS cx, arg_max(seq, {{'w': w, 's': -seq}}) AS widest FROM g GROUP BY page""",
)
def bbox_agg(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, centroids and the first of the widest marks per page."""
    box = glyphs(spark, d).groupBy("page").agg(
        F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"),
        F.max(F.col("x") + F.col("w")).cast("double").alias("x1"),
        F.max(F.col("y") + F.col("h")).cast("double").alias("y1"),
        F.max("size").cast("double").alias("max_size"), F.min("size").cast("double").alias("min_size"),
        F.round(F.avg(F.col("x") + F.col("w") * f32(0.5)), 3).alias("cx"),
        F.max_by("seq", F.struct(F.col("w"), (-F.col("seq")).alias("s"))).alias("widest"),
    )
    return box


# --- flow and text fitting --------------------------------------------------------------------

ITEM = {
    "page": "event_id DIV 64",
    "item": "event_id",
    "is_image": "event_type = 'purchase'",
    "col": "user_id % 3 - 1",
    "top": "CAST(user_id * 5 AS FLOAT)",
    "x": "CAST(user_id * 3 AS FLOAT)",
    "width": "CAST(20 + user_id * 6 AS FLOAT)",
    "height": "CAST((user_id % 5) * 250 AS FLOAT)",
    "lines": "CAST(1 + event_id % 9 AS INTEGER)",
}

_SQL_FLOW = f"""it AS (SELECT {_cols(ITEM)} FROM events),
    fl AS (SELECT *, CASE WHEN is_image THEN CASE WHEN width >= 560::FLOAT * 0.5::FLOAT THEN 0 WHEN x + width / 2::FLOAT < 280::FLOAT THEN 1 ELSE 2 END ELSE col + 1 END AS part FROM it),
    fo AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY part, top, is_image, item) - 1 AS place FROM fl)"""


@query(
    "flow_order", "U3,L3",
    f"WITH {_SQL_FLOW} SELECT page, item, part::INTEGER AS part, place::INTEGER AS place FROM fo",
)
def flow_order(spark: SparkSession, d: str) -> DataFrame:
    flow = L.flow_order(derive(spark, d, "events", ITEM), PAGE_WIDTH)
    return flow.select("page", "item", F.col("part").cast("int").alias("part"), "place")


@query(
    "flow_paginate", "K8,W9",
    f"""WITH RECURSIVE {_SQL_FLOW},
        c AS (SELECT *, greatest(0.1::FLOAT, CASE WHEN height > 0 THEN width / height ELSE 1 END)::FLOAT AS ratio, 488::FLOAT AS room, 720::FLOAT AS tall, lines::FLOAT * (8.8::FLOAT * 1.22::FLOAT) AS th FROM fo),
        e AS (SELECT *, least(488::FLOAT * 0.88::FLOAT, width) AS w0, (least(488::FLOAT * 0.88::FLOAT, width) / ratio)::FLOAT AS h0 FROM c),
        g AS (SELECT *, CASE WHEN is_image THEN h0 + 12::FLOAT ELSE th + 4::FLOAT END AS needed,
                     CASE WHEN NOT is_image THEN th WHEN h0 > tall AND tall * ratio > room THEN (room / ratio)::FLOAT WHEN h0 > tall THEN tall ELSE h0 END AS hh,
                     CASE WHEN NOT is_image THEN room WHEN h0 > tall THEN least(tall * ratio, room) ELSE w0 END AS ww FROM e),
        f AS (SELECT page, place, item, 0 AS sheet, 756::FLOAT AS tp, 756::FLOAT - hh - CASE WHEN is_image THEN 12::FLOAT ELSE 4::FLOAT END AS nxt, ww, hh FROM g WHERE place = 0
              UNION ALL
              SELECT page, place, item, CASE WHEN turn THEN sheet + 1 ELSE sheet END, CASE WHEN turn THEN 756::FLOAT ELSE nxt END,
                     CASE WHEN turn THEN 756::FLOAT ELSE nxt END - hh - CASE WHEN is_image THEN 12::FLOAT ELSE 4::FLOAT END, ww, hh
              FROM (SELECT g.*, f.sheet, f.nxt, f.nxt - g.needed < 36 AND f.nxt < 756::FLOAT - 2::FLOAT AS turn FROM f JOIN g ON g.page = f.page AND g.place = f.place + 1))
        SELECT page, item, sheet::INTEGER AS sheet, tp::DOUBLE AS top, ww::DOUBLE AS width, hh::DOUBLE AS height FROM f""",
)
def flow_paginate(spark: SparkSession, d: str) -> DataFrame:
    flow = L.flow_order(derive(spark, d, "events", ITEM), PAGE_WIDTH)
    placed = L.paginate(flow, PAGE_WIDTH, PAGE_HEIGHT)
    return placed.select(
        "page", "item", "sheet", *[F.col(c).cast("double").alias(c) for c in ("top", "width", "height")]
    )


_WORDS = r"string_split_regex({p}, '\s+')"


@query(
    "wrap_text", "P40",
    rf"""WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(ps) AS para, generate_subscripts(ps, 1) AS pi
                   FROM (SELECT conv_id, turn, string_split_regex(text, '\n+') AS ps FROM conversations)),
        q AS (SELECT conv_id, turn, pi, {_WORDS.format(p=S.trim_low('para'))} AS ws FROM p),
        w AS (SELECT conv_id, turn, pi, 1 AS i, 0 AS line, ws[1] AS cur, ws FROM q
              UNION ALL
              SELECT conv_id, turn, pi, i + 1, CASE WHEN cur <> '' AND (length(cur) + 1 + length(ws[i + 1]))::FLOAT * 8::FLOAT * 0.5::FLOAT > 200 THEN line + 1 ELSE line END,
                     CASE WHEN cur <> '' AND (length(cur) + 1 + length(ws[i + 1]))::FLOAT * 8::FLOAT * 0.5::FLOAT > 200 THEN ws[i + 1]
                          WHEN cur = '' THEN ws[i + 1] ELSE cur || ' ' || ws[i + 1] END, ws
              FROM w WHERE i < len(ws)),
        l AS (SELECT conv_id, turn, pi, line, arg_max(cur, i) AS txt FROM w GROUP BY ALL)
        SELECT conv_id, turn, count(*)::BIGINT AS lines, sha256(string_agg(txt, '|' ORDER BY pi, line)) AS lines_hash FROM l GROUP BY conv_id, turn""",
)
def wrap_text(spark: SparkSession, d: str) -> DataFrame:
    wrapped = G.wrap_lines(F.col("text"), f32(8), f32(200))
    lines = table(spark, d, "conversations").select("conv_id", "turn", wrapped.alias("l"))
    return lines.select(
        "conv_id", "turn", F.size("l").cast("bigint").alias("lines"),
        X.content_hash(F.array_join("l", "|")).alias("lines_hash"),
    )


@query(
    "fit_font", "P41",
    rf"""WITH RECURSIVE t AS (SELECT item_id, {S.trim_low('text')} AS txt, CAST(6 + item_id % 14 AS FLOAT) AS fs, CAST(120 + item_id % 200 AS FLOAT) AS bw, CAST(40 + item_id % 90 AS FLOAT) AS bh FROM benchmark),
        s AS (SELECT *, 0 AS step, greatest(5.5::FLOAT, least(18::FLOAT, fs)) AS size FROM t
              UNION ALL SELECT item_id, txt, fs, bw, bh, step + 1, greatest(5.5::FLOAT, size - 0.45::FLOAT) FROM s WHERE size > 5.5::FLOAT),
        p AS (SELECT item_id, step, size, bw, bh, unnest(ps) AS para, generate_subscripts(ps, 1) AS pi FROM (SELECT *, string_split_regex(txt, '\n+') AS ps FROM s)),
        q AS (SELECT *, list_transform({_WORDS.format(p=S.trim_low('para'))}, lambda x: length(x)) AS ws FROM p),
        w AS (SELECT item_id, step, size, bw, bh, pi, 1 AS i, 1 AS n, ws[1] AS cur, ws FROM q
              UNION ALL
              SELECT item_id, step, size, bw, bh, pi, i + 1, CASE WHEN (cur + 1 + ws[i + 1])::FLOAT * size * 0.5::FLOAT > bw THEN n + 1 ELSE n END,
                     CASE WHEN (cur + 1 + ws[i + 1])::FLOAT * size * 0.5::FLOAT > bw THEN ws[i + 1] ELSE cur + 1 + ws[i + 1] END, ws FROM w WHERE i < len(ws)),
        c AS (SELECT item_id, step, size, bh, sum(n) AS lines FROM (SELECT item_id, step, size, bh, pi, max(n) AS n FROM w GROUP BY ALL) GROUP BY ALL),
        f AS (SELECT *, lines::FLOAT * (size * 1.16::FLOAT) <= bh OR size <= 5.5::FLOAT AS fits FROM c)
        SELECT item_id, arg_min(size, step)::DOUBLE AS size, arg_min(lines, step)::INTEGER AS lines FROM f WHERE fits GROUP BY item_id""",
)
def fit_font(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    fitted = G.fit_font(F.col("text"), f32(6 + i % 14), f32(120 + i % 200), f32(40 + i % 90))
    fits = spread(table(spark, d, "benchmark")).select("item_id", fitted.alias("f"))
    return fits.select("item_id", F.col("f.size").cast("double").alias("size"), "f.lines")


@query(
    "footer_filter", "P36",
    f"""WITH t AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' ALL Rights Reserved' WHEN 1 THEN ' https://doi.org/x' ELSE '' END AS txt, CAST(700 + doc_id % 80 AS FLOAT) AS y FROM documents)
        SELECT doc_id, y > 757 OR contains(lower(txt), 'j obstet gynaecol can') OR contains(lower(txt), 'https://doi.org/') OR contains(lower(txt), '© 2018')
               OR contains(lower(txt), 'published by elsevier') OR contains(lower(txt), 'all rights reserved') AS footer FROM t""",
)
def footer_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    tail = F.when(k % 5 == 0, " ALL Rights Reserved").when(k % 5 == 1, " https://doi.org/x").otherwise("")
    footer = X.is_footer(F.concat("text", tail), f32(700 + k % 80), F.lit(PAGE_HEIGHT))
    return table(spark, d, "documents").select("doc_id", footer.alias("footer"))


FORM_EDGE = {
    "page": "event_id DIV 64",
    "parent": "event_id - 1 - user_id % 31",
    "child": "event_id",
}


@query(
    "xobject_closure", "U6",
    f"""WITH RECURSIVE e AS (SELECT {_cols(FORM_EDGE)} FROM events
                   UNION ALL SELECT event_id // 64, event_id, event_id - user_id % 5 FROM events),
        r AS (SELECT DISTINCT page, page * 64 + 7 AS node FROM e
              UNION
              SELECT e.page, e.child FROM r JOIN e ON e.page = r.page AND e.parent = r.node)
        SELECT page, node FROM r""",
)
def xobject_closure(spark: SparkSession, d: str) -> DataFrame:
    """Forms reachable from the first one of a page; some edges point back."""
    from ..operators.closure import reachable

    down = derive(spark, d, "events", FORM_EDGE)
    back = derive(
        spark, d, "events",
        {"page": "event_id DIV 64", "parent": "event_id", "child": "event_id - user_id % 5"},
    )
    edges = down.unionByName(back)
    roots = edges.select("page").distinct().withColumn("node", F.col("page") * 64 + 7)
    return reachable(edges, roots)


@query(
    "text_table_regions", "C11,C10",
    f"""WITH RECURSIVE {_SQL_ROWS}, {_SQL_DIVIDERS},
        er AS (SELECT page, row, arg_min(y, {{'y': y, 'x': x, 's': seq}}) AS y, min(x) AS lo, arg_max(x + w, {{'x': x, 'y': y, 's': seq}}) AS hi FROM rws GROUP BY page, row),
        nr AS (SELECT er.*, dividers FROM er JOIN dv USING (page) WHERE len(list_filter(dividers, lambda g: g > lo + 8::FLOAT AND g < hi - 8::FLOAT)) > 0),
        pp AS (SELECT page, list(y ORDER BY y) AS ys, min(lo) AS lo, max(hi) AS hi, any_value(dividers) AS dividers FROM nr GROUP BY page HAVING count(*) >= 4),
        u AS (SELECT page, ys, {_UNIQUE.format(xs="[lo - 2::FLOAT, hi + 2::FLOAT] || dividers", tol=2.0)} AS v, {_UNIQUE.format(xs="ys", tol=5.0)} AS h FROM pp)
        SELECT page, v[1]::DOUBLE AS x0, v[len(v)]::DOUBLE AS x1, (ys[1] - 3::FLOAT)::DOUBLE AS top, (ys[len(ys)] + 12::FLOAT)::DOUBLE AS bottom,
               len(v)::INTEGER AS columns, len(h)::INTEGER AS rows FROM u WHERE len(v) >= 3""",
)
def text_table_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = L.row_numbers(glyphs(spark, d))
    found = L.text_table_regions(rows, L.divider_positions(rows, PAGE_WIDTH))
    edges = ("x0", "x1", "top", "bottom")
    return found.select(
        "page", *[F.col(f"region.{c}").cast("double").alias(c) for c in edges],
        F.size("region.verticals").alias("columns"), F.size("region.horizontals").alias("rows"),
    )


PLAN_UNIT = {
    "page": "event_id DIV 256",
    "unit": "event_id",
    "text": "concat(event_type, ' of user ', user_id, ' with ', props)",
    **{n: GLYPH[n] for n in ("x", "y")},
    "width": "CAST(30 + user_id % 90 AS FLOAT)",
    "height": "CAST(10 + event_id % 30 AS FLOAT)",
    "size": "CAST(5 + user_id % 16 AS FLOAT)",
}


@query(
    "page_plan", "K7,J8,J11,P40,P41",
    rf"""WITH RECURSIVE un AS (SELECT {_cols(PLAN_UNIT)} FROM events), {_SQL_REGIONS},
        c AS (SELECT u.*, x + width * 0.5::FLOAT AS cx, y + height * 0.5::FLOAT AS cy FROM un u),
        k AS (SELECT c.*, coalesce(list_filter(verticals, lambda b: b <= cx + 1::FLOAT)[-1], x0) AS cl, coalesce(list_filter(verticals, lambda b: b > cx + 1::FLOAT)[1], x1) AS cr,
              coalesce(list_filter(horizontals, lambda b: b <= cy + 1::FLOAT)[-1], top) AS ct, coalesce(list_filter(horizontals, lambda b: b > cy + 1::FLOAT)[1], bottom) AS cb,
              cx >= (x0 + x1) * 0.5::FLOAT AS mid
              FROM c LEFT JOIN regions r ON r.page = c.page AND cx >= x0 - 3::FLOAT AND cx <= x1 + 3::FLOAT AND cy >= top - 3::FLOAT AND cy <= bottom + 3::FLOAT),
        im AS (SELECT page, x AS ix, y AS it FROM un),
        sh AS (SELECT u.page, u.unit, min(i.ix - u.x - 3::FLOAT) AS room FROM un u JOIN im i ON i.page = u.page AND i.it + 40::FLOAT > u.y + 1::FLOAT
               AND i.it < u.y + u.height - 1::FLOAT AND i.ix > u.x AND i.ix - u.x - 3::FLOAT > 10 GROUP BY ALL),
        b AS (SELECT k.*, coalesce(cr - cl >= 12 AND cb - ct >= 6, false) AS in_cell, least(greatest(10::FLOAT, width), coalesce(room, width)) AS safe FROM k LEFT JOIN sh USING (page, unit)),
        g AS (SELECT *, CASE WHEN in_cell THEN greatest(12::FLOAT, cr - cl - 6::FLOAT) WHEN safe >= width - 0.5::FLOAT THEN width ELSE greatest(10::FLOAT, safe) END AS bw,
                     CASE WHEN in_cell THEN greatest(7::FLOAT, cb - ct - 1.2::FLOAT * 2::FLOAT) ELSE greatest(10::FLOAT, height) END AS bh,
                     CASE WHEN in_cell THEN 5.3::FLOAT ELSE 5.5::FLOAT END AS low, CASE WHEN in_cell THEN 1.14::FLOAT ELSE 1.16::FLOAT END AS ld,
                     CASE WHEN in_cell THEN 0.25::FLOAT ELSE 0.45::FLOAT END AS dec, string_split_regex(text, '\s+') AS ws FROM b),
        sz AS (SELECT page, unit, 0 AS n, greatest(low, least(CASE WHEN in_cell THEN 9.2::FLOAT ELSE 18::FLOAT END, size)) AS fs FROM g
               UNION ALL SELECT s.page, s.unit, n + 1, greatest(low, fs - dec) FROM sz s JOIN g USING (page, unit) WHERE fs > low),
        tr AS (SELECT s.page, s.unit, s.n, s.fs, list_reduce(list_transform(ws, lambda w: [w]), lambda acc, w:
                 CASE WHEN (length(acc[len(acc)]) + 1 + length(w[1]))::FLOAT * s.fs * 0.5::FLOAT > bw THEN acc || w
                 ELSE acc[1:len(acc) - 1] || [acc[len(acc)] || ' ' || w[1]] END) AS ls, bh, low, ld FROM sz s JOIN g USING (page, unit)),
        ok AS (SELECT page, unit, arg_min(fs, n) AS fs, arg_min(ls, n) AS ls FROM tr WHERE len(ls)::FLOAT * (fs * ld) <= bh OR fs <= low GROUP BY page, unit),
        ro AS (SELECT g.*, ok.fs, ok.ls, unnest(ok.ls) AS t, generate_subscripts(ok.ls, 1) - 1 AS line FROM g JOIN ok USING (page, unit))
        SELECT page, unit, line::INTEGER AS line, t AS text, in_cell, round(fs::DOUBLE, 4) AS size,
               round((CASE WHEN NOT in_cell THEN x WHEN mid THEN greatest(cl + (cr - cl - length(t)::FLOAT * fs * 0.5::FLOAT) * 0.5::FLOAT, cl + 0.5::FLOAT) ELSE cl + 3::FLOAT END)::DOUBLE, 2) AS x,
               round((greatest(1::FLOAT, 792::FLOAT - (CASE WHEN in_cell THEN ct + 1.2::FLOAT + greatest(0::FLOAT, (bh - len(ls)::FLOAT * (fs * ld)) * 0.5::FLOAT) + fs * 0.78::FLOAT
                   ELSE y + fs * 0.84::FLOAT END + line::FLOAT * (fs * ld))))::DOUBLE, 2) AS baseline FROM ro""",
)
def page_plan(spark: SparkSession, d: str) -> DataFrame:
    units = derive(spark, d, "events", PLAN_UNIT)
    images = units.select(
        "page", "x", F.col("y").alias("top"), f32(40).alias("height")
    )
    plan = L.page_plan(units, images, L.table_regions(guides(spark, d), PAGE_HEIGHT), PAGE_HEIGHT)
    return plan.select(
        "page", "unit", "line", "text", "in_cell",
        F.round(F.col("size").cast("double"), 4).alias("size"),
        F.round(F.col("x").cast("double"), 2).alias("x"),
        F.round(F.col("baseline").cast("double"), 2).alias("baseline"),
    )
