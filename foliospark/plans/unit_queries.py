"""Unit extraction, document profile and rebuild over the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import glossary as G
from ..operators import profile as PF
from ..operators import units as U
from ..sources import archive as A
from . import sqltext as S
from .registry import query, spread, table


def book_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as content files of an archive."""
    name = F.concat(F.lit("OEBPS/page"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    return spread(table(spark, d, "pages").select("page_id", name.alias("file"), "html"))


def page_units(spark: SparkSession, d: str) -> DataFrame:
    pages = book_pages(spark, d).filter(U.is_content_file(F.col("file")))
    return U.extract_units(pages, "file", "html", keep=("page_id",))


@query(
    "page_profile", "A1,S4,D2",
    r"""SELECT regexp_extract(html, '(?i)<html lang="([^"]*)"', 1) AS lang, count(*)::BIGINT AS files,
               sum(len(regexp_extract_all(html, '(?i)<p[\s/>]')))::BIGINT AS p_count,
               sum(len(regexp_extract_all(html, '(?i)<figure[\s/>]')))::BIGINT AS figure_count,
               sum(len(regexp_extract_all(html, '(?i)<table[\s/>]')))::BIGINT AS table_count,
               sum(len(regexp_extract_all(html, '(?i)<img[\s/>]')))::BIGINT AS img_count
        FROM pages GROUP BY 1""",
)
def page_profile(spark: SparkSession, d: str) -> DataFrame:
    lang = F.regexp_extract("html", '(?i)<html lang="([^"]*)"', 1)
    pages = table(spark, d, "pages").select(lang.alias("lang"), "html")
    return PF.markup_profile(pages, ["lang"])


@query(
    "unit_counts_by_tag", "C1,U1,F1,A2",
    f"""WITH {S.UNITS}
        SELECT lower(tag) AS tag, count(*)::BIGINT AS units,
               count(*) FILTER (WHERE translatable)::BIGINT AS translatable,
               sum(length(plain))::BIGINT AS visible_chars, sum(length(inner_html))::BIGINT AS markup_chars
        FROM units GROUP BY 1""",
)
def unit_counts_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return (
        page_units(spark, d)
        .groupBy(F.lower("tag").alias("tag"))
        .agg(
            F.count(F.lit(1)).alias("units"),
            F.count_if("translatable").alias("translatable"),
            F.sum(F.length("plain").cast("bigint")).alias("visible_chars"),
            F.sum(F.length("inner").cast("bigint")).alias("markup_chars"),
        )
    )


@query(
    "extract_units", "C1,S5,D4,D5,W1,P1,P14,F1",
    f"""WITH {S.UNITS}
        SELECT id, file, ordinal::INTEGER AS ordinal, start_at AS start, end_at AS "end", tag, attrs,
               source_hash, sha256(plain) AS plain_hash, translatable FROM units""",
)
def extract_units(spark: SparkSession, d: str) -> DataFrame:
    return page_units(spark, d).select(
        "id", "file", "ordinal", "start", "end", "tag", "attrs", "source_hash",
        X.content_hash(F.col("plain")).alias("plain_hash"), "translatable",
    )


@query(
    "leaf_containers", "F2",
    f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '{S.CONTAINERS}')) AS m FROM pages)
        SELECT page_id, count(*)::BIGINT AS containers,
               count(*) FILTER (WHERE NOT regexp_matches(substr(m, strpos(m, '>')), '{S.ANY_BLOCK}'))::BIGINT AS leaves
        FROM m GROUP BY page_id""",
)
def leaf_containers(spark: SparkSession, d: str) -> DataFrame:
    boxes = F.regexp_extract_all("html", F.lit(P.CONTAINER), F.lit(3))
    counted = table(spark, d, "pages").select("page_id", boxes.alias("boxes"))
    return counted.filter(F.size("boxes") > 0).select(
        "page_id",
        F.size("boxes").cast("bigint").alias("containers"),
        F.size(F.filter("boxes", lambda b: ~b.rlike(P.ANY_BLOCK))).cast("bigint").alias("leaves"),
    )


@query("rebuild_identity", "K2,J5", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def rebuild_identity(spark: SparkSession, d: str) -> DataFrame:
    """Putting every unit's own source back leaves the document as it was."""
    pages = book_pages(spark, d)
    same = page_units(spark, d).select("file", "ordinal", F.col("inner").alias("translation"))
    rebuilt = U.rebuild(pages, "file", "html", same)
    page_id = F.regexp_extract("file", r"page(\d+)\.xhtml$", 1).cast("bigint")
    return rebuilt.select(
        page_id.alias("page_id"), X.content_hash(F.col("content")).alias("content_hash")
    )


@query(
    "rebuild_replace", "K2,J4,J5,L2,A8",
    f"""WITH RECURSIVE {S.UNITS},
        walk AS (SELECT page_id, ordinal, end_at AS at, true AS kept FROM units WHERE ordinal = 0
                 UNION ALL
                 SELECT u.page_id, u.ordinal, CASE WHEN u.start_at >= w.at THEN u.end_at ELSE w.at END, u.start_at >= w.at
                 FROM walk w JOIN units u ON u.page_id = w.page_id AND u.ordinal = w.ordinal + 1),
        kept AS (SELECT u.* FROM units u JOIN walk w USING (page_id, ordinal) WHERE w.kept),
        p AS (SELECT k.page_id, k.start_at, k.end_at, substr(html, coalesce(lag(k.end_at) OVER (PARTITION BY k.page_id ORDER BY k.start_at), 0) + 1,
                 k.start_at - coalesce(lag(k.end_at) OVER (PARTITION BY k.page_id ORDER BY k.start_at), 0)) ||
                 CASE WHEN translatable AND ordinal % 2 = 0 THEN '<' || tag || attrs || '>' || '«' || inner_html || '»' || '</' || tag || '>'
                      ELSE substr(html, k.start_at + 1, k.end_at - k.start_at) END AS piece
              FROM kept k JOIN pages USING (page_id))
        SELECT page_id, sha256(coalesce(string_agg(piece, '' ORDER BY start_at), '') || substr(any_value(html), coalesce(max(end_at), 0) + 1)) AS content_hash,
               0::INTEGER AS misplaced
        FROM pages LEFT JOIN p USING (page_id) GROUP BY page_id""",
)
def rebuild_replace(spark: SparkSession, d: str) -> DataFrame:
    """Every second translatable unit is replaced by its quoted source."""
    done = page_units(spark, d).filter("translatable AND ordinal % 2 = 0")
    done = done.select("file", "ordinal", F.concat(F.lit("«"), F.col("inner"), F.lit("»")).alias("translation"))
    rebuilt = U.rebuild(book_pages(spark, d), "file", "html", done)
    page_id = F.regexp_extract("file", r"page(\d+)\.xhtml$", 1).cast("bigint")
    return rebuilt.select(
        page_id.alias("page_id"),
        X.content_hash(F.col("content")).alias("content_hash"),
        "misplaced",
    )


#: A book for each page: what its package document lists, and its first bytes.
_SQL_BOOK = """page_id % 4 + 1 AS xhtml, page_id % 3 AS css, page_id % 5 AS image, page_id % 2 AS other"""
_XML = '<?xml version="1.0"?>'


def book_entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the books, and their entries as an archive reader gives them: the
    declared type (missing or wrong in some), the container, and a package document that lists
    content files, styles and pictures under a base folder."""
    pages = table(spark, d, "pages").select("page_id", "url", F.col("page_id").cast("string").alias("path"))
    head = F.element_at(
        F.array(*[F.unhex(F.lit(x)) for x in ("504B0304AA", "255044462D31", "504B0506", "3C68746D6C3E", "504B0304")]),
        (F.col("page_id") % 5 + 1).cast("int"),
    )
    files = pages.select(F.concat("path", F.lit(".epub")).alias("path"), head.alias("content"))

    def listed(kind: str, n: Column, media: str, place: str) -> Column:
        item = lambda i: F.format_string(f'<item media-type="{media}" href="{place}"/>', i)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), n), item), "")).otherwise("")

    p = F.col("page_id")
    items = F.concat(
        listed("xhtml", p % 4 + 1, "application/xhtml+xml", "../text/c%d.xhtml"), listed("css", p % 3, "text/css", "s%d.css"),
        listed("image", p % 5, "image/png", "./img/%d.png"), listed("other", p % 2, "font/otf", "f%d.otf"),
    )
    title = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    package = F.concat(
        F.lit(f'{_XML}<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> '),
        title, F.lit(" </dc:title></metadata><manifest>"), items, F.lit("</manifest></package>"),
    )
    opf = F.concat(F.lit("B"), (p % 7).cast("string"), F.lit("/p.opf"))
    container = F.concat(
        F.lit(f'{_XML}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="'),
        opf, F.lit('"/></rootfiles></container>'),
    )
    declared = F.when(p % 6 == 1, "text/plain").when(p % 6 != 2, " application/epub+zip ")
    rows = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), name.alias("name"), text.alias("text"))
        for i, (name, text) in enumerate([
            (F.lit("mimetype"), declared), (F.lit("META-INF/container.xml"), container), (opf, package),
        ])
    ])
    unpacked = pages.select(F.concat("path", F.lit(".epub")).alias("path"), F.explode(rows).alias("e")).select(
        "path", "e.ordinal", "e.name", F.encode("e.text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error")
    )
    return files, unpacked.filter("content IS NOT NULL")


@query(
    "package_documents", "S1,S2,S3,S4,S21",
    f"""WITH b AS (SELECT page_id, trim(url) AS title, {_SQL_BOOK} FROM pages)
        SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'pdf' WHEN 3 THEN NULL ELSE 'zip' END AS kind,
          CASE WHEN page_id % 5 = 3 THEN 'not a PDF or EPUB file' WHEN page_id % 5 = 1 THEN NULL
            WHEN page_id % 6 = 2 THEN 'mimetype is missing' WHEN page_id % 6 = 1 THEN 'mimetype is not valid' END AS problem,
          'B' || page_id % 7 || '/p.opf' AS opf, title, xhtml::BIGINT AS xhtml, css::BIGINT AS css, image::BIGINT AS image,
          'text/c' || xhtml || '.xhtml' AS last_text, CASE WHEN image > 0 THEN 'B' || page_id % 7 || '/img/1.png' END AS first_image
        FROM b""",
)
def package_documents(spark: SparkSession, d: str) -> DataFrame:
    """Books that the page table describes, through the checks and the package reader."""
    files, unpacked = book_entries(spark, d)
    items = A.package_items(unpacked)
    name = F.struct("place", "name")
    per_book = items.groupBy("path").agg(
        F.first("title").alias("title"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("xhtml", "css", "image")],
        F.max(F.when(F.col("kind") == "xhtml", name))["name"].alias("last_text"),
        F.min(F.when(F.col("kind") == "image", name))["name"].alias("first_image"),
    )
    verdicts = A.checked(files, unpacked).select("path", "kind", "problem")
    joined = verdicts.join(A.package_paths(unpacked), "path").join(per_book, "path")
    return joined.select(
        F.regexp_extract("path", r"^(\d+)\.epub$", 1).cast("bigint").alias("page_id"), "kind", "problem", "opf", "title",
        "xhtml", "css", "image", "last_text", "first_image",
    )


@query(
    "glossary_lines", "S12",
    """SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'English word' ELSE p_name END AS english,
              'a' || chr(10) || p_brand AS vietnamese, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS category, '' AS note
       FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0""",
)
def glossary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a terminology file: headers in any case, missing sides, blanks around fields,
    written line breaks."""
    k = F.col("p_partkey")
    english = (
        F.when(k % 7 == 0, F.lit(" ENGLISH")).when(k % 11 == 0, F.lit("  ")).when(k % 5 == 0, F.lit("English word "))
        .otherwise(F.concat(F.lit("\t"), "p_name", F.lit(" ")))
    )
    lines = table(spark, d, "part").select(
        k.alias("ord"), english.alias("english"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" a\\n"), "p_brand")).alias("vietnamese"),
        F.when(k % 4 != 0, F.concat("p_type", F.lit("  "))).alias("category"), F.lit(" ").alias("note"),
    )
    return G.clean_terms(lines)
