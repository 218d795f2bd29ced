"""The translation ladder end to end, with a translator that returns its source."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import jobs
from ..operators import sequence as SQ
from ..operators import state as ST
from ..operators import translate as TR
from ..operators import units as U
from ..operators.offline import prompt_adapter
from ..operators.staging import checkpoint_folder, durable
from ..operators.translate import BATCH
from ..sources import state as ST_SRC
from . import sqltext as S
from .registry import query, spread, table


def echo(text: str) -> str:
    return text


def lossy(prompt: str, context: str) -> str:
    """Answers like ``echo`` but loses the last block of a page and the last of several items."""
    answer = prompt_adapter(echo)(prompt, context)
    if answer.startswith("[[["):
        return answer[: answer.rindex("[[[")]
    items = answer.rfind(', {"id"')
    return answer if items < 0 else answer[:items] + "]"


def careless(prompt: str, context: str) -> str:
    """Answers like ``echo``, but of texts with one ``w`` (or 6, 11, ...) nothing until it is told
    what was wrong, and of texts with two (or 7, 12, ...) nothing at all."""
    head, _, fragment = prompt.rpartition("\n\n")

    def answered(text: str) -> bool:
        n = text.count("w") % 5
        return n not in (1, 2) or (n == 1 and head.startswith("Translate the whole unit"))

    if prompt.startswith(BATCH):
        items = [i for i in json.loads(prompt_adapter(echo)(prompt, context)) if answered(i["translation"])]
        return json.dumps(items, ensure_ascii=False)
    return prompt_adapter(echo)(prompt, context) if answered(fragment) else ""


#: What ``careless`` leaves of a unit, from its text without markup.
_W = "(length(plain) - length(replace(plain, 'w', ''))) % 5"


@query(
    "translate_units", "C3,C4,C5,C6,C15,C16,P46",
    f"""WITH {S.UNITS}
        SELECT id, CASE {_W} WHEN 2 THEN 'SOURCE_ONLY' ELSE 'DONE' END AS status,
          CASE {_W} WHEN 2 THEN 'last' WHEN 1 THEN 'retry 1' ELSE CASE WHEN length(plain) <= 80 THEN 'direct' ELSE 'batch' END END AS step,
          sha256(CASE {_W} WHEN 2 THEN '' ELSE plain END) AS text_hash
        FROM units WHERE translatable""",
)
def translate_units(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("OEBPS/page"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    pages = spread(table(spark, d, "pages").select(name.alias("file"), "html"))
    units = durable(U.extract_units(pages, "file", "html").filter("translatable"))
    batches = SQ.greedy_batches(units, "file", "ordinal", X.utf16_length(F.col("inner")))
    batched = units.join(batches.drop("size"), ["file", "ordinal"])
    candidates = TR.batch_candidates(batched, ["file", "batch_no"], careless)
    rows = TR.translate_units(units, careless, candidates)
    return rows.select(
        "id", "status", "step", X.content_hash(X.strip_markup(F.col("translation"))).alias("text_hash")
    )


@query(
    "translate_pages", "C12,C13,T5,P31",
    rf"""SELECT doc_id // 10 AS page, false AS failed, count(*)::BIGINT AS units,
               sha256(string_agg('[[[UNIT_' || (doc_id % 10) || ']]] ' || {S.trim_low(r"regexp_replace(text, '\s+', ' ', 'g')")}, ' ' ORDER BY doc_id)) AS text_hash
        FROM documents GROUP BY doc_id // 10""",
)
def translate_pages(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "documents").select(
        F.expr("doc_id div 10").alias("page"),
        (F.col("doc_id") % 10).cast("int").alias("unit"),
        X.trim_low(F.regexp_replace("text", r"\s+", " ")).alias("source"),
    )
    pages = TR.translate_pages(units, lossy)
    flat = X.trim_low(F.regexp_replace("text", r"\s+", " "))
    return pages.select(
        "page", "failed",
        F.regexp_count("text", F.lit(r"\[\[\[UNIT_\d+\]\]\]")).cast("bigint").alias("units"),
        X.content_hash(flat).alias("text_hash"),
    )


@query(
    "page_job", "C13,C12,S7,S14,K9,T5,L6",
    rf"""WITH p AS (
          SELECT doc_id // 800 AS file, doc_id // 10 AS page, count(*)::BIGINT AS units,
            sha256(string_agg('[[[UNIT_' || (doc_id % 10) || ']]] ' || {S.trim_low(r"regexp_replace(text, '\s+', ' ', 'g')")}, ' ' ORDER BY doc_id)) AS text_hash
          FROM documents GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (ORDER BY file, page) - 1 AS place FROM p)
        SELECT 'book' || file AS file, page, units, text_hash, false AS failed,
          CASE WHEN place // 16 < 2 THEN 1 ELSE 2 END::BIGINT AS run FROM n""",
)
def page_job(spark: SparkSession, d: str) -> DataFrame:
    """A first run commits two slices and ends, a second one does the rest; ``run`` tells which
    run a page is from."""
    units = table(spark, d, "documents").select(
        F.expr("concat('book', doc_id div 800)").alias("file"), F.expr("doc_id div 10").alias("page"),
        (F.col("doc_id") % 10).cast("int").alias("unit"),
        X.trim_low(F.regexp_replace("text", r"\s+", " ")).alias("source"),
    )
    path = f"{checkpoint_folder(spark)}/page-job-{uuid.uuid4().hex}"
    jobs.page_job(units, path, lossy, pages_per_slice=16, slices=2)
    first = ST_SRC.read_pages(spark, path).select("file", "page", F.lit(1).cast("bigint").alias("run"))
    first = durable(first)
    pages = jobs.page_job(units, path, lossy, pages_per_slice=4_000)
    flat = X.trim_low(F.regexp_replace("text", r"\s+", " "))
    return pages.join(first, ["file", "page"], "left").select(
        "file", "page", "failed",
        F.regexp_count("text", F.lit(r"\[\[\[UNIT_\d+\]\]\]")).cast("bigint").alias("units"),
        X.content_hash(flat).alias("text_hash"), F.coalesce("run", F.lit(2).cast("bigint")).alias("run"),
    )


@query(
    "book_job", "C6,C3,C4,J1,J2,J4,K2,K3,A12",
    rf"""WITH {S.UNITS},
        n AS (SELECT page_id, count(*) FILTER (translatable) AS units,
          count(*) FILTER (translatable AND ordinal % 3 <> 0 AND {_W} = 2) AS kept FROM units GROUP BY page_id)
        SELECT page_id, sha256(regexp_replace(html, '\s+', '', 'g')) AS content_hash, 0::INTEGER AS misplaced,
               coalesce(units, 0)::BIGINT AS state_rows, coalesce(kept, 0)::BIGINT AS kept_source
        FROM pages LEFT JOIN n USING (page_id)""",
)
def book_job(spark: SparkSession, d: str) -> DataFrame:
    """A third of the units are saved as done, a third with a hash that is out of date. The
    translator returns its source or nothing, so the book comes out as it was; units without an
    answer keep their source and are marked."""
    name = F.concat(F.lit("OEBPS/page"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    files = table(spark, d, "pages").select(name.alias("file"), "html")
    units = U.extract_units(files, "file", "html").filter("translatable AND ordinal % 3 < 2")
    saved = units.select(
        "id", "file",
        F.when(F.col("ordinal") % 3 == 0, F.col("source_hash")).otherwise("old").alias("source_hash"),
        F.col("inner").alias("translation"), F.lit(ST.DONE).alias("status"), F.lit(0).alias("attempts"),
    )
    content, state = jobs.book_job(files, saved, careless)
    rows = state.groupBy("file").agg(
        F.count(F.lit(1)).alias("state_rows"), F.count_if(F.col("status") == ST.SOURCE_ONLY).alias("kept_source")
    )
    return content.join(rows, "file", "left").select(
        F.regexp_extract("file", r"page(\d+)\.xhtml$", 1).cast("bigint").alias("page_id"),
        X.content_hash(F.regexp_replace("content", r"\s+", "")).alias("content_hash"), "misplaced",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("state_rows", "kept_source")],
    )
