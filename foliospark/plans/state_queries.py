"""Validation, saved state, batching and glossary over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import patterns as P
from ..functions import response as R
from ..functions import text as X
from ..operators import glossary as G
from ..operators import sequence as SQ
from ..operators import state as ST
from ..operators import validate as V
from . import sqltext as S
from .registry import query, spread, table

# --- validation -----------------------------------------------------------------------

PAIR_SRC = (
    "CASE WHEN conv_id % 11 = 0 THEN 'Renal' WHEN conv_id % 11 = 5 THEN '<b>Feature</b>'"
    " WHEN turn % 4 = 0 THEN question || ' 10-20% of 5:3 and ABC-1.2 or 12.5%.' ELSE question END"
)
PAIR_DST = (
    "CASE (conv_id + turn) % 6 WHEN 0 THEN answer WHEN 1 THEN question WHEN 2 THEN left(question, 30)"
    " WHEN 3 THEN question || ' 10-20% 12,5%' WHEN 4 THEN '  <br/> ' ELSE 'Bệnh thận, đặc điểm' END"
)

_SQL_REASON = f"""
    t AS (SELECT *, {S.strip('src')} AS s, {S.strip('dst')} AS d FROM pairs),
    n AS (SELECT *, {S.sentence_count('s')} AS sn, {S.sentence_count('d')} AS dn,
                 {S.important_tokens('s')} AS need, {S.important_tokens('d')} AS have FROM t),
    c AS (SELECT *, len(need) AS total, coalesce(list_sum(list_transform(list_distinct(need),
                 lambda k: least(len(list_filter(need, lambda x: x = k)), len(list_filter(have, lambda x: x = k))))), 0) AS covered FROM n),
    v AS (SELECT *, CASE
        WHEN {S.trim_low('dst')} = '' THEN 'AI trả về nội dung trống'
        WHEN length(s) < 2 THEN NULL
        WHEN length(d) = 0 THEN 'bản dịch không có nội dung nhìn thấy'
        WHEN length(s) >= 80 AND length(d) < greatest(20, length(s) * 0.30) THEN 'bản dịch ngắn bất thường so với nội dung nguồn'
        WHEN sn >= 3 AND dn < sn - 1 THEN 'thiếu câu (nguồn ' || sn || ' câu, bản dịch ' || dn || ' câu)'
        WHEN total > 0 AND covered < greatest(1, ceil(total * 0.75)) THEN
             'thiếu số liệu/citation quan trọng (' || covered::BIGINT || '/' || total || ' token được giữ lại)'
        WHEN lower(s) = 'feature' AND lower(d) NOT IN ('đặc điểm', 'đặc trưng') THEN 'heading Feature chưa được dịch'
        WHEN lower(s) = 'renal' AND NOT contains(lower(d), 'thận') THEN 'heading Renal chưa được dịch'
        WHEN lower(s) = 'seizure' AND NOT contains(lower(d), 'co giật') THEN 'heading Seizure chưa được dịch'
        WHEN lower(s) = 'prenatal' AND NOT contains(lower(d), 'trước sinh') THEN 'heading Prenatal chưa được dịch'
        WHEN lower(s) = 'definition' AND NOT contains(lower(d), 'định nghĩa') THEN 'heading Definition chưa được dịch'
        WHEN lower(s) = 'classic signs' AND NOT contains(lower(d), 'dấu hiệu') THEN 'heading Classic Signs chưa được dịch'
        END AS reason FROM c)"""

_SQL_PAIRS = f"""turns AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
               WHERE u.role = 'user' AND a.role = 'assistant'),
    pairs AS (SELECT conv_id, turn, {PAIR_SRC} AS src, {PAIR_DST} AS dst FROM turns)"""


def answered_turns(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant turn after it; (conv_id, turn) keys the join,
    so one long conversation spreads over all partitions."""
    conv = table(spark, d, "conversations")
    users = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = conv.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return users.join(answers, ["conv_id", "turn"])


def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return answered_turns(spark, d).select(
        "conv_id", "turn", F.expr(PAIR_SRC).alias("src"), F.expr(PAIR_DST).alias("dst")
    )


@query(
    "validation_reason", "C2,F3,P45,J7,J15,A4,A10",
    f"""WITH {_SQL_PAIRS}, {_SQL_REASON}
        SELECT conv_id, turn, reason, covered::BIGINT AS covered, total::BIGINT AS total,
               reason IS NULL AS complete FROM v""",
)
def validation_reason(spark: SparkSession, d: str) -> DataFrame:
    checked = V.with_reason(answer_pairs(spark, d), "src", "dst")
    return checked.select(
        "conv_id", "turn", "reason",
        F.col("reason_covered").cast("bigint").alias("covered"),
        F.col("reason_total").cast("bigint").alias("total"),
        F.col("reason").isNull().alias("complete"),
    )


@query(
    "validation_summary", "C2,A2",
    f"""WITH {_SQL_PAIRS}, {_SQL_REASON}
        SELECT regexp_replace(coalesce(reason, 'ok'), '[0-9]+', '#', 'g') AS verdict, count(*)::BIGINT AS pairs,
               sum(length(s))::BIGINT AS source_chars FROM v GROUP BY 1""",
)
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    checked = V.with_reason(answer_pairs(spark, d), "src", "dst")
    verdict = F.regexp_replace(F.coalesce("reason", F.lit("ok")), "[0-9]+", "#")
    return checked.groupBy(verdict.alias("verdict")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.length(X.strip_markup(F.col("src"))).cast("bigint")).alias("source_chars"),
    )


@query(
    "token_coverage", "J7,A4",
    f"""WITH t AS (SELECT doc_id, token, count(*) AS n FROM
                     (SELECT doc_id, unnest({S.important_tokens('text')}) AS token FROM documents) GROUP BY ALL)
        SELECT a.doc_id, sum(a.n)::BIGINT AS total, sum(least(a.n, coalesce(b.n, 0)))::BIGINT AS covered,
               sum(least(a.n, coalesce(b.n, 0))) >= greatest(1, ceil(sum(a.n) * 0.75)) AS enough
        FROM t a LEFT JOIN t b ON b.token = a.token AND b.doc_id = a.doc_id + 20 GROUP BY a.doc_id""",
)
def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Multiset coverage as relations: each document against the next one of its source.
    Only (document, token, count) rows meet; the texts stay where they are."""
    tokens = spread(table(spark, d, "documents")).select(
        "doc_id", F.explode_outer(X.important_tokens(F.col("text"))).alias("token")
    ).filter("token IS NOT NULL")
    counts = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    have = counts.select((F.col("doc_id") - 20).alias("doc_id"), "token", F.col("n").alias("m"))
    kept = F.least("n", F.coalesce("m", F.lit(0)))
    sums = counts.join(have, ["doc_id", "token"], "left").groupBy("doc_id").agg(
        F.sum("n").alias("total"), F.sum(kept).alias("covered")
    )
    required = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(0.75)).cast("int"))
    return sums.withColumn("enough", F.col("covered") >= required)


# --- saved state ------------------------------------------------------------------------

SAVED_TEXT = (
    "CASE WHEN quality = 1 THEN text WHEN doc_id % 3 = 0 THEN '' ELSE left(text, 25) END"
)


def document_units(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select(
        F.col("source").alias("file"), F.col("doc_id").alias("ordinal"), F.col("text").alias("inner")
    )
    hashed = docs.withColumn("source_hash", X.content_hash(F.col("inner")))
    return hashed.withColumns(
        {
            "id": X.unit_id(F.col("file"), F.col("ordinal"), F.col("source_hash")),
            "translatable": F.length("inner") >= 2,
        }
    )


def saved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as saved state; toxic ones were saved from another text."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("ordinal"), "quality", "toxic")
    saved = document_units(spark, d).join(labels, "ordinal")
    stale = X.content_hash(F.concat(F.col("inner"), F.lit("~")))
    text = F.expr(SAVED_TEXT.replace("doc_id", "ordinal").replace("text", "inner"))
    return saved.select(
        "id", "file",
        F.when(F.col("toxic") == 1, stale).otherwise(F.col("source_hash")).alias("source_hash"),
        text.alias("translation"),
        F.when(text == "", ST.SOURCE_ONLY).otherwise(ST.DONE).alias("status"),
        F.when(text == "", 3).otherwise(0).alias("attempts"),
    )


_SQL_STATE = f"""u AS (SELECT source AS file, doc_id, text, sha256(text) AS source_hash,
                 sha256(source || '|' || doc_id || '|' || sha256(text)) AS id FROM documents),
    st AS (SELECT u.id, u.file, CASE WHEN toxic = 1 THEN sha256(text || '~') ELSE source_hash END AS source_hash,
                  {SAVED_TEXT} AS translation, u.doc_id FROM u JOIN labels l USING (doc_id)),
    pairs AS (SELECT u.id, u.file, u.doc_id, u.text AS src, st.translation AS dst, st.id AS sid
              FROM u LEFT JOIN (SELECT * FROM st WHERE {S.trim_low('translation')} <> '') st
              ON st.id = u.id AND st.source_hash = u.source_hash)"""


@query(
    "state_left_join", "J1,S13,A2",
    f"""WITH {_SQL_STATE}, {_SQL_REASON}
        SELECT file, count(*)::BIGINT AS units, count(*) FILTER (WHERE sid IS NOT NULL AND reason IS NULL)::BIGINT AS done
        FROM v GROUP BY file""",
)
def state_left_join(spark: SparkSession, d: str) -> DataFrame:
    recovered = ST.recover(document_units(spark, d), saved_rows(spark, d))
    return recovered.groupBy("file").agg(
        F.count(F.lit(1)).alias("units"), F.count_if("done").alias("done")
    )


@query(
    "pending_anti", "J2,C6",
    f"""WITH {_SQL_STATE}, {_SQL_REASON}
        SELECT id, file, doc_id FROM v WHERE NOT (sid IS NOT NULL AND reason IS NULL) AND length(src) >= 2""",
)
def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    units = document_units(spark, d)
    done = ST.recover(units, saved_rows(spark, d)).filter("done")
    return ST.pending(units, done).select("id", "file", F.col("ordinal").alias("doc_id"))


@query(
    "stale_state_rejected", "T3,S13",
    f"""WITH {_SQL_STATE}
        SELECT st.id, st.doc_id FROM st JOIN u ON u.id = st.id WHERE st.source_hash <> u.source_hash""",
)
def stale_state_rejected(spark: SparkSession, d: str) -> DataFrame:
    units = document_units(spark, d).select("id", "source_hash", F.col("ordinal").alias("doc_id"))
    saved = saved_rows(spark, d).select("id", F.col("source_hash").alias("saved_hash"))
    return units.join(saved, "id").filter("saved_hash <> source_hash").select("id", "doc_id")


@query(
    "state_merge", "K3,T1",
    f"""WITH {_SQL_STATE}, fresh AS (SELECT id, upper(file) AS translation FROM u WHERE doc_id % 5 = 0)
        SELECT coalesce(f.id, s.id) AS id, sha256(coalesce(f.translation, s.translation)) AS translation_hash,
               CASE WHEN f.id IS NOT NULL THEN 1 WHEN s.translation = '' THEN 3 ELSE 0 END AS attempts
        FROM st s FULL OUTER JOIN fresh f ON f.id = s.id""",
)
def state_merge(spark: SparkSession, d: str) -> DataFrame:
    fresh = document_units(spark, d).filter("ordinal % 5 = 0").select(
        "id", "file", "source_hash", F.upper("file").alias("translation"),
        F.lit(ST.DONE).alias("status"), F.lit(1).alias("attempts"),
    )
    merged = ST.merge(saved_rows(spark, d), fresh)
    return merged.select(
        "id", X.content_hash(F.col("translation")).alias("translation_hash"), "attempts"
    )


@query(
    "manifest", "D7,K4,A12,A13,P43",
    f"""WITH {_SQL_STATE},
        t AS (SELECT file, count(*) FILTER (WHERE length(text) >= 2) AS total FROM u GROUP BY file),
        s AS (SELECT file, count(*) FILTER (WHERE translation <> '') AS done, count(*) AS n FROM st GROUP BY file)
        SELECT file, 3 AS version, total::BIGINT AS total_units, coalesce(done, 0)::BIGINT AS completed_units,
               coalesce(n, 0)::BIGINT AS state_rows,
               CASE WHEN total <= 0 THEN 0 ELSE floor(100.0 * coalesce(done, 0) / total) END::INTEGER AS percent,
               'Đã dịch ' || coalesce(done, 0) || '/' || total || ' unit' AS summary
        FROM t LEFT JOIN s USING (file)""",
)
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return ST.manifest(document_units(spark, d), saved_rows(spark, d), "file")


_ANSWER_SQL = """'Here: ```' || chr(10) || '[' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE
    '{"id":"' || id || '","translation":"t' || doc_id || '"},{"id":"' || id || 'x","translation":"other"},' END ||
    '{"id":"","translation":"lost"}] done'"""


@query(
    "batch_semi", "J3,C4,P4",
    f"""WITH {_SQL_STATE} SELECT id, 't' || doc_id AS translation FROM u WHERE doc_id % 4 <> 0""",
)
def batch_semi(spark: SparkSession, d: str) -> DataFrame:
    """Answers come back as text; only items whose id was asked for are kept."""
    units = document_units(spark, d).select("id", F.col("ordinal").alias("doc_id"))
    answers = units.select(F.explode_outer(R.id_texts(F.expr(_ANSWER_SQL))).alias("x")).select("x.*")
    return answers.join(units, "id", "left_semi").select("id", "translation")


@query(
    "missing_units", "J14",
    """WITH t AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
        e AS (SELECT conv_id, unnest(generate_series(0, last)) AS turn FROM t)
        SELECT e.conv_id, e.turn FROM e ANTI JOIN (SELECT * FROM conversations WHERE role <> 'assistant') c
        ON c.conv_id = e.conv_id AND c.turn = e.turn""",
)
def missing_units(spark: SparkSession, d: str) -> DataFrame:
    conv = table(spark, d, "conversations")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    expected = last.select("conv_id", F.explode(F.expr("sequence(0L, last)")).alias("turn"))
    return ST.missing_ids(expected, conv.filter("role <> 'assistant'"), ["conv_id", "turn"])


_PAGE_STATE = (
    "CASE WHEN event_type = 'error' THEN '' ELSE event_type END",
    "event_type = 'signup' AND user_id % 2 = 0",
    "CASE WHEN user_id % 10 = 0 THEN '8' ELSE '9' END",
)


@query(
    "page_state", "S14,L6,T5,D18,K9",
    f"""WITH p AS (SELECT event_id // 100 AS book, event_id AS page, {_PAGE_STATE[0]} AS text, {_PAGE_STATE[1]} AS failed,
                          {_PAGE_STATE[2]} AS v FROM events),
        s AS (SELECT book, page, CASE WHEN v = '9' THEN text ELSE '' END AS text, v = '9' AND failed AS failed FROM p)
        SELECT book, coalesce(min(page) FILTER (WHERE text = '' AND NOT failed), -1)::BIGINT AS first_unfinished,
               count(*) FILTER (WHERE failed)::BIGINT AS failed_pages,
               count(*) FILTER (WHERE NOT failed AND text <> '')::BIGINT AS finished_pages FROM s GROUP BY book""",
)
def page_state(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.state import current_pages

    text, failed, version = (F.expr(e) for e in _PAGE_STATE)
    saved = table(spark, d, "events").select(
        F.expr("event_id div 100").alias("book"), F.col("event_id").alias("page"),
        text.alias("text"), failed.alias("failed"), version.alias("layout_version"),
    )
    return ST.first_unfinished(current_pages(saved), "book")


# --- batching -----------------------------------------------------------------------------

_SQL_BATCHES = """n AS (SELECT source, doc_id, text, length(text) + 180 AS cost,
             row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    b AS (SELECT source, doc_id, rn, 0 AS batch_no, 1 AS units, cost AS chars FROM n WHERE rn = 1
          UNION ALL
          SELECT n.source, n.doc_id, n.rn,
                 CASE WHEN b.units >= 8 OR b.chars + n.cost > 12000 THEN b.batch_no + 1 ELSE b.batch_no END,
                 CASE WHEN b.units >= 8 OR b.chars + n.cost > 12000 THEN 1 ELSE b.units + 1 END,
                 CASE WHEN b.units >= 8 OR b.chars + n.cost > 12000 THEN n.cost ELSE b.chars + n.cost END
          FROM b JOIN n ON n.source = b.source AND n.rn = b.rn + 1)"""


def document_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "source", "doc_id", X.utf16_length(F.col("text")).alias("size")
    )
    return SQ.greedy_batches(docs, "source", "doc_id", F.col("size"))


@query(
    "greedy_batches", "W2",
    f"WITH RECURSIVE {_SQL_BATCHES} SELECT source, doc_id, batch_no::BIGINT AS batch_no FROM b",
)
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return document_batches(spark, d).select("source", "doc_id", "batch_no")


@query(
    "batch_chars", "A3,W2",
    f"""WITH RECURSIVE {_SQL_BATCHES} SELECT source, batch_no::BIGINT AS batch_no, count(*)::BIGINT AS units,
        sum(cost - 180)::BIGINT AS chars FROM b JOIN n USING (source, doc_id) GROUP BY ALL""",
)
def batch_chars(spark: SparkSession, d: str) -> DataFrame:
    return document_batches(spark, d).groupBy("source", "batch_no").agg(
        F.count(F.lit(1)).alias("units"), F.sum("size").cast("bigint").alias("chars")
    )


def json_line(id_: Column, source: Column) -> Column:
    return F.concat(
        F.lit('{"id":"'), X.escape_json(id_), F.lit('","source":"'), X.escape_json(source), F.lit('"}')
    )


@query(
    "batch_requests", "P46,A11,D11",
    rf"""WITH RECURSIVE {_SQL_BATCHES},
        l AS (SELECT source, batch_no, doc_id, '{{"id":"' || doc_id || '","source":"' ||
              replace(replace(replace(replace(p, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r') || '"}}' AS line
              FROM (SELECT b.source, batch_no, b.doc_id, {S.protect('text')} AS p FROM b JOIN n USING (source, doc_id)))
        SELECT source, batch_no::BIGINT AS batch_no, sha256(string_agg(line, chr(10) ORDER BY doc_id)) AS body_hash
        FROM l GROUP BY source, batch_no""",
)
def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    """The JSON lines of each batch; a group is one batch, at most 8 units."""
    batches = document_batches(spark, d).select("source", "doc_id", "batch_no")
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    docs = docs.join(batches, ["source", "doc_id"])
    line = json_line(F.col("doc_id").cast("string"), M.protect_markup(F.col("text")))
    lines = docs.select("source", "batch_no", "doc_id", line.alias("line"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"])
    return lines.groupBy("source", "batch_no").agg(
        X.content_hash(F.array_join(body, "\n")).alias("body_hash")
    )


@query(
    "log_sequence", "W11,D19,K5",
    r"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' #' || row_number() OVER (ORDER BY event_id) || ' '
               || upper(event_type) || ' ' || translate(props, '|', '/') AS line FROM events""",
)
def log_sequence(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.logs import log_lines

    events = table(spark, d, "events").select(
        "event_id", "ts", F.upper("event_type").alias("stage"), F.col("props").alias("message")
    )
    return log_lines(events, "event_id").select("event_id", "line")


# --- glossary -------------------------------------------------------------------------------


def base_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.initcap("p_name").alias("english"),
        F.concat(F.lit("vi "), F.col("p_name")).alias("vietnamese"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("note"),
    )


def imported_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark texts, in text order, with many repeats."""
    words = F.split(X.trim_low(F.col("text")), r"\s+", -1)
    word = F.regexp_replace("w", r"[.,;:!?]+$", "")
    return (
        table(spark, d, "benchmark")
        .select("item_id", F.posexplode(words).alias("pos", "w"))
        .select(
            (F.col("item_id") * 100000 + F.col("pos")).alias("ord"),
            word.alias("english"), F.concat(F.lit("vi "), word).alias("vietnamese"),
            F.lit("import").alias("category"), F.lit("").alias("note"),
        )
        .filter("english <> ''")
    )


_SQL_TERMS = rf"""base AS (SELECT p_partkey AS ord, p_name AS english, p_type AS category, p_brand AS note FROM part),
    wl AS (SELECT item_id, string_split_regex({S.trim_low('text')}, '\s+') AS ws FROM benchmark),
    words AS (SELECT item_id * 100000 + generate_subscripts(ws, 1) - 1 AS ord,
                     regexp_replace(unnest(ws), '[.,;:!?]+$', '') AS english FROM wl),
    both_terms AS (SELECT 0 AS src, ord, lower({S.trim_low('english')}) AS key, category, note FROM base
             UNION ALL SELECT 1, ord, lower({S.trim_low('english')}), 'import', '' FROM words WHERE english <> ''),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, ord) AS rn FROM both_terms) WHERE rn = 1)"""


def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    merged = G.merge_first_wins(base_terms(spark, d), imported_terms(spark, d))
    return merged.withColumn("ord", F.col("src").cast("bigint") * (1 << 40) + F.col("ord"))


@query(
    "glossary_merge_first_wins", "U2,S12,A10",
    f"""WITH {_SQL_TERMS} SELECT key, ord::BIGINT AS ord, category, note, src = 1 AS added FROM merged""",
)
def glossary_merge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    merged = G.merge_first_wins(base_terms(spark, d), imported_terms(spark, d))
    return merged.select("key", "ord", "category", "note", "added")


@query(
    "glossary_match_top40", "J6,L4",
    f"""WITH {_SQL_TERMS},
        hits AS (SELECT d.doc_id, m.src * 1099511627776 + m.ord AS ord FROM documents d
                 JOIN merged m ON contains(lower(d.text), m.key) WHERE length(m.key) >= 2)
        SELECT doc_id, ord::BIGINT AS ord, rank::INTEGER AS rank FROM
          (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rank FROM hits) WHERE rank <= 40""",
)
def glossary_match_top40(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return G.match_terms(docs, "doc_id", "text", merged_terms(spark, d))


@query(
    "glossary_prompt", "P46,J6,A11",
    f"""WITH {_SQL_TERMS},
        hits AS (SELECT c.conv_id, c.turn, m.src * 1099511627776 + m.ord AS ord, m.key, m.note FROM conversations c
                 JOIN merged m ON contains(lower(c.text), m.key) WHERE length(m.key) >= 2),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS rank FROM hits) WHERE rank <= 40)
        SELECT conv_id, turn, sha256(string_agg('- ' || key || ' → vi ' || key || CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END,
               chr(10) ORDER BY ord)) AS prompt_hash FROM top GROUP BY conv_id, turn""",
)
def glossary_prompt(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "conversations").select(
        F.struct("conv_id", "turn").alias("text_id"), "text"
    )
    terms = merged_terms(spark, d).withColumns(
        {"english": F.col("key"), "vietnamese": F.concat(F.lit("vi "), F.col("key"))}
    )
    lines = G.prompt_lines(G.match_terms(texts, "text_id", "text", terms), "text_id", terms)
    return lines.select("text_id.*", X.content_hash(F.col("terminology")).alias("prompt_hash"))


@query(
    "glossary_search", "F7",
    f"""WITH {_SQL_TERMS} SELECT key, ord::BIGINT AS ord FROM merged WHERE contains(key, 'ring') OR contains('vi ' || key, 'ring')""",
)
def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    merged = G.merge_first_wins(base_terms(spark, d), imported_terms(spark, d))
    return G.search(merged, " RING ").select("key", "ord")


@query(
    "glossary_clashes", "U5",
    f"""WITH {_SQL_TERMS} SELECT w.ord::BIGINT AS ord, w.english FROM words w WHERE w.english <> '' AND EXISTS
        (SELECT 1 FROM base b WHERE lower(b.english) = lower(w.english)
         UNION ALL SELECT 1 FROM words o WHERE lower(o.english) = lower(w.english) AND o.ord <> w.ord)""",
)
def glossary_clashes(spark: SparkSession, d: str) -> DataFrame:
    words = imported_terms(spark, d)
    own = words.select("ord", "english")
    known = base_terms(spark, d).select((-F.col("ord") - 1).alias("ord"), "english").unionByName(own)
    return G.clashes(known, words).select("ord", "english")
