"""Translatable units of a markup document: scan, identify, rebuild.

A document is one row. Matching, merging and rebuilding are row-local array
expressions, so a scan needs no shuffle and no page is ever gathered from
several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import patterns as P
from ..functions import predicates as PR
from ..functions import text as X

CONTENT_FILE = r"(?i)\.(xhtml|html|htm)$"


def is_content_file(name: Column) -> Column:
    """By extension, in any case."""
    return name.rlike(CONTENT_FILE)


def _starts(gaps: Column, hits: Column) -> Column:
    """Offset of each match: running sum of the gap and match lengths before it."""
    spans = F.zip_with(
        gaps, hits, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        F.filter(spans, lambda s: s["m"].isNotNull()),
        zero,
        lambda acc, s: F.struct(
            (acc["at"] + s["g"] + s["m"]).alias("at"),
            F.array_append(acc["starts"], acc["at"] + s["g"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def _headed(m: Column, start: Column) -> Column:
    tag = F.regexp_extract(m, "^<([A-Za-z0-9]+)", 1)
    return F.struct(start.alias("start"), m.alias("m"), tag.alias("tag"), F.instr(m, ">").alias("gt"))


def _candidate(x: Column) -> Column:
    m, name = x["m"], F.length(x["tag"])
    return F.struct(
        x["start"].alias("start"),
        (x["start"] + F.length(m)).alias("end"),
        x["tag"].alias("tag"),
        F.substring(m, name + 2, x["gt"] - name - 2).alias("attrs"),
        F.substring(m, x["gt"] + 1, F.length(m) - x["gt"] - name - 3).alias("inner"),
    )


def with_candidates(pages: DataFrame, html: str, out: str = "candidates") -> DataFrame:
    """Block elements and leaf containers of each row, by start offset."""
    for name, pattern in (("_b", P.BLOCK), ("_c", P.CONTAINER)):
        pages = pages.withColumns(
            {
                f"{name}m": F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0)),
                f"{name}g": F.split(F.col(html), pattern, -1),
            }
        )

    def family(hits: str, gaps: str) -> Column:
        headed = F.zip_with(hits, _starts(F.col(gaps), F.col(hits)), _headed)
        return F.transform(headed, _candidate)

    blocks, containers = family("_bm", "_bg"), family("_cm", "_cg")
    leaves = F.filter(containers, lambda c: ~c["inner"].rlike(P.ANY_BLOCK))
    return pages.withColumn(out, F.sort_array(F.concat(blocks, leaves))).drop(
        "_bm", "_bg", "_cm", "_cg"
    )


def extract_units(pages: DataFrame, file: str, html: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per unit with its identity hash and the translatable flag."""
    base = pages.select(*keep, F.col(file).alias("file"), F.col(html).alias("_html"))
    base = with_candidates(base, "_html").drop("_html")
    # Text is stripped before the explode: as a plain column of the exploded row it
    # is computed once, wherever later filters end up. The outer explode keeps
    # Catalyst from copying the whole scan expression into an inferred filter.
    described = F.transform(
        "candidates", lambda c: c.withField("plain", X.strip_markup(c["inner"]))
    )
    exploded = base.select(*keep, "file", F.posexplode_outer(described).alias("ordinal", "c"))
    units = exploded.filter("ordinal IS NOT NULL").select(
        *keep,
        "file",
        "ordinal",
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.col("c.tag").alias("tag"),
        F.col("c.attrs").alias("attrs"),
        F.col("c.inner").alias("inner"),
        X.content_hash(F.col("c.inner")).alias("source_hash"),
        F.col("c.plain").alias("plain"),
    )
    return units.withColumns(
        {
            "id": X.unit_id(F.col("file"), F.col("ordinal"), F.col("source_hash")),
            "translatable": PR.should_translate(F.col("attrs"), F.col("plain")),
        }
    )


def outermost(candidates: Column) -> Column:
    """Candidates that do not start inside an earlier one, with their ordinal.

    Replacing both an element and one nested in it would corrupt the text, so
    the outer one wins."""
    numbered = F.transform(candidates, lambda c, i: F.struct(i.alias("ordinal"), c.alias("c")))
    item = "struct<ordinal:int,c:struct<start:int,end:int,tag:string,attrs:string,inner:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("kept"))
    return F.aggregate(
        numbered,
        zero,
        lambda acc, x: F.when(
            x["c"]["start"] >= acc["at"],
            F.struct(
                x["c"]["end"].alias("at"), F.array_append(acc["kept"], x).alias("kept")
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def rebuild(pages: DataFrame, file: str, html: str, translations: DataFrame) -> DataFrame:
    """Every page with its translated units put back in place.

    ``translations`` has (file, ordinal, translation). They are gathered per file,
    never more than the file has units, and joined to the page once; the text is
    then stitched from gaps and replacements without leaving the row. A page with
    no translation comes out unchanged. ``misplaced`` counts translations whose
    ordinal the page does not have."""
    per_file = (
        translations.filter(~X.is_blank(F.col("translation")))
        .groupBy("file")
        .agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "translation"))).alias("_new"))
    )
    joined = pages.select(F.col(file).alias("file"), F.col(html).alias("_html")).join(
        per_file, "file", "left"
    )
    staged = with_candidates(joined, "_html", "_all").withColumn("_kept", outermost(F.col("_all")))

    def piece(x: Column, i: Column) -> Column:
        c = x["c"]
        before = F.when(i == 0, F.lit(0)).otherwise(
            F.try_element_at(F.col("_kept"), F.greatest(i, F.lit(1)))["c"]["end"]
        )
        gap = F.substring(F.col("_html"), before + 1, c["start"] - before)
        new = F.col("_new")[x["ordinal"]]
        replaced = F.concat(
            F.lit("<"), c["tag"], c["attrs"], F.lit(">"), new, F.lit("</"), c["tag"], F.lit(">")
        )
        same = F.substring(F.col("_html"), c["start"] + 1, c["end"] - c["start"])
        return F.concat(gap, F.coalesce(replaced, same))

    last = F.coalesce(F.try_element_at(F.col("_kept"), F.lit(-1))["c"]["end"], F.lit(0))
    rest = F.substring(F.col("_html"), last + 1, F.length("_html"))
    wanted = F.coalesce(F.map_keys("_new"), F.array().cast("array<int>"))
    return staged.select(
        "file",
        F.concat(F.array_join(F.transform("_kept", piece), ""), rest).alias("content"),
        F.size(F.filter(wanted, lambda k: (k < 0) | (k >= F.size("_all")))).alias("misplaced"),
    )


def with_protected(units: DataFrame) -> DataFrame:
    """Units with placeholders in place of markup, and the markup to restore."""
    return units.withColumns(
        {
            "tokens": M.markup_tokens(F.col("inner")),
            "protected": M.protect_markup(F.col("inner")),
        }
    )
