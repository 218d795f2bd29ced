"""Scalar text operators over documents, pages, conversations and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import predicates as PR
from ..functions import text as X
from . import sqltext as S
from .registry import query, spread, table

FENCED = (
    "CASE doc_id % 4 WHEN 0 THEN '```html\n' || text || '\n```' WHEN 1 THEN 'Answer: <p>' || text"
    " || '</p> done' WHEN 2 THEN '```' || text || '```  ' ELSE text END"
)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


@query(
    "strip_markup", "P1,P14",
    f"SELECT page_id, sha256(plain) AS plain_hash, length(plain)::BIGINT AS plain_chars"
    f" FROM (SELECT page_id, {S.strip('html')} AS plain FROM pages)",
)
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    plain = spread(table(spark, d, "pages")).select("page_id", X.strip_markup(F.col("html")).alias("plain"))
    return plain.select(
        "page_id",
        X.content_hash(F.col("plain")).alias("plain_hash"),
        F.length("plain").cast("bigint").alias("plain_chars"),
    )


@query(
    "clean_output", "P2,P3,L7",
    f"""WITH t AS (SELECT doc_id, {S.drop_fence('raw')} AS body
                   FROM (SELECT doc_id, {FENCED} AS raw FROM documents)),
        p AS (SELECT *, strpos(body, '<') AS a, length(body) - strpos(reverse(body), '>') + 1 AS b FROM t)
        SELECT doc_id, sha256(body) AS fragment_hash, sha256({S.trim_low('body')}) AS answer_hash,
               sha256(CASE WHEN a > 1 AND contains(body, '>') AND b > a
                      THEN {S.trim_low('substr(body, a, b - a + 1)')} ELSE body END) AS cut_hash
        FROM p""",
)
def clean_output(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", F.expr(FENCED).alias("raw"))
    return raw.select(
        "doc_id",
        X.content_hash(X.clean_fragment(F.col("raw"))).alias("fragment_hash"),
        X.content_hash(X.clean_model_output(F.col("raw"))).alias("answer_hash"),
        X.content_hash(X.clean_fragment(F.col("raw"), cut_prose=True)).alias("cut_hash"),
    )


@query(
    "sentence_stats", "P7,A3",
    f"""SELECT source, lang, sum({S.sentence_count('text')})::BIGINT AS sentences,
               sum(length(text))::BIGINT AS chars, count(*)::BIGINT AS docs
        FROM documents GROUP BY source, lang""",
)
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return (
        documents(spark, d)
        .groupBy("source", "lang")
        .agg(
            F.sum(X.sentence_count(F.col("text"))).alias("sentences"),
            F.sum(F.length("text").cast("bigint")).alias("chars"),
            F.count(F.lit(1)).alias("docs"),
        )
    )


@query(
    "split_sentences", "P8",
    f"""SELECT doc_id, (pos - 1)::BIGINT AS position, sentence FROM (
          SELECT doc_id, unnest({S.split_sentences('text')}) AS sentence,
                 generate_subscripts({S.split_sentences('text')}, 1) AS pos FROM documents)""",
)
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = X.split_sentences(F.col("text"))
    return (
        documents(spark, d)
        .select("doc_id", F.posexplode_outer(parts).alias("position", "sentence"))
        .filter("position IS NOT NULL")
        .withColumn("position", F.col("position").cast("bigint"))
    )


@query(
    "important_tokens", "P9",
    f"""SELECT token, count(*)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS docs
        FROM (SELECT doc_id, unnest({S.important_tokens('text')}) AS token FROM documents)
        GROUP BY token""",
)
def important_tokens(spark: SparkSession, d: str) -> DataFrame:
    hits = documents(spark, d).select(
        "doc_id", F.explode_outer(X.important_tokens(F.col("text"))).alias("token")
    ).filter("token IS NOT NULL")
    per_doc = hits.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(
        F.sum("n").alias("hits"), F.count(F.lit(1)).alias("docs")
    )


@query(
    "language_words", "P10,P11,P12",
    f"""SELECT lang, sum({S.english_words('text')})::BIGINT AS english_words,
               sum({S.vietnamese_words('text')})::BIGINT AS vietnamese_words,
               count(*) FILTER (WHERE {S.has_vietnamese('text')})::BIGINT AS marked_docs
        FROM documents GROUP BY lang""",
)
def language_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return (
        documents(spark, d)
        .groupBy("lang")
        .agg(
            F.sum(X.english_words(text)).cast("bigint").alias("english_words"),
            F.sum(X.vietnamese_words(text)).cast("bigint").alias("vietnamese_words"),
            F.count_if(X.has_vietnamese(text)).alias("marked_docs"),
        )
    )


@query(
    "protect_markup", "P5",
    f"""SELECT page_id, len(regexp_extract_all(html, '{S.MARKUP}'))::BIGINT AS marks,
               sha256({S.protect('html')}) AS protected_hash FROM pages""",
)
def protect_markup(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select(
        "page_id",
        F.size(M.markup_tokens(F.col("html"))).cast("bigint").alias("marks"),
        X.content_hash(M.protect_markup(F.col("html"))).alias("protected_hash"),
    )


@query(
    "restore_roundtrip", "P6",
    f"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '{S.MARKUP}') AS toks FROM pages)
        SELECT page_id,
               CASE WHEN page_id % 3 = 1 AND len(toks) > 0 THEN NULL
                    WHEN page_id % 3 = 2 AND len(toks) > 0 THEN NULL ELSE sha256(html) END AS restored_hash
        FROM p""",
)
def restore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A lost (page_id % 3 = 1) or repeated (= 2) placeholder makes the answer invalid."""
    tokens = M.markup_tokens(F.col("html"))
    marked = spread(table(spark, d, "pages")).select(
        "page_id", tokens.alias("tokens"), M.protect_markup(F.col("html")).alias("answer")
    )
    first = M.placeholder(F.lit(0))
    damaged = (
        F.when(F.col("page_id") % 3 == 1, F.replace("answer", first, F.lit("")))
        .when(F.col("page_id") % 3 == 2, F.concat(F.col("answer"), first))
        .otherwise(F.col("answer"))
    )
    return marked.withColumn("answer", damaged).select(
        "page_id",
        X.content_hash(M.restore_markup(F.col("answer"), F.col("tokens"))).alias("restored_hash"),
    )


@query(
    "translatable_gaps", "C16",
    rf"""SELECT page_id, len(g)::BIGINT AS gaps, sha256(array_to_string(g, '|')) AS gap_hash FROM (
          SELECT page_id, list_filter(string_split_regex(html, '{S.MARKUP}'),
                                      lambda x: regexp_matches(x, '\p{{L}}')) AS g FROM pages)""",
)
def translatable_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "pages").select(
        "page_id", M.translatable_gaps(F.col("html")).alias("g")
    )
    return gaps.select(
        "page_id",
        F.size("g").cast("bigint").alias("gaps"),
        X.content_hash(F.array_join("g", "|")).alias("gap_hash"),
    )


@query(
    "long_text_chunks", "W3",
    r"""WITH RECURSIVE s AS (
          SELECT doc_id, text, string_split(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
          FROM documents WHERE length(text) > 1400),
        f AS (
          SELECT doc_id, 1 AS i, 0 AS chunk, parts[1] AS cur, parts FROM s
          UNION ALL
          SELECT doc_id, i + 1,
                 CASE WHEN length(cur) > 0 AND length(cur) + length(parts[i + 1]) + 1 > 1400 THEN chunk + 1 ELSE chunk END,
                 CASE WHEN length(cur) > 0 AND length(cur) + length(parts[i + 1]) + 1 > 1400 THEN parts[i + 1]
                      WHEN length(cur) > 0 THEN cur || ' ' || parts[i + 1] ELSE parts[i + 1] END,
                 parts
          FROM f WHERE i < len(parts))
        SELECT doc_id, chunk::BIGINT AS chunk_no, sha256(arg_max(cur, i)) AS chunk_hash
        FROM f GROUP BY doc_id, chunk HAVING arg_max(cur, i) <> ''
        UNION ALL
        SELECT doc_id, 0::BIGINT, sha256(text) FROM documents WHERE length(text) <= 1400""",
)
def long_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return (
        documents(spark, d)
        .select("doc_id", F.posexplode_outer(X.chunk_long_text(F.col("text"))).alias("chunk_no", "chunk"))
        .select(
            "doc_id",
            F.col("chunk_no").cast("bigint").alias("chunk_no"),
            X.content_hash(F.col("chunk")).alias("chunk_hash"),
        )
    )


@query(
    "path_normalize", "P15,P16",
    r"""SELECT page_id, list_reduce(
              list_transform(list_filter(string_split(raw, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x]),
              lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE acc || x END,
              []::VARCHAR[]).array_to_string('/') AS path,
            regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name
        FROM (SELECT page_id, url, 'OEBPS/./text//' || CASE WHEN page_id % 3 = 0 THEN '../../../' ELSE '' END
                     || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || '/../p' || page_id || '.xhtml' AS raw
              FROM pages)""",
)
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(
        F.lit("OEBPS/./text//"),
        F.when(F.col("page_id") % 3 == 0, "../../../").otherwise(""),
        F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1),
        F.lit("/../p"),
        F.col("page_id").cast("string"),
        F.lit(".xhtml"),
    )
    return table(spark, d, "pages").select(
        "page_id",
        X.normalize_path(raw).alias("path"),
        X.safe_key(F.col("url")).alias("safe_name"),
    )


@query(
    "log_sanitize", "P17,P27,P28,K5,L7",
    rf"""SELECT conv_id, turn, sha256(translate(text, chr(10) || chr(13) || '|', '  /')) AS line_hash,
               sha256(CASE WHEN length(t) > 1200 THEN left(t, 1200) || '…' ELSE t END) AS compact_hash,
               sha256(right(text, 1000)) AS tail_hash, left(sha256(text), 12) AS short_id
        FROM (SELECT *, {S.trim_low(r"regexp_replace(text, '\s+', ' ', 'g')")} AS t FROM conversations)""",
)
def log_sanitize(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        X.content_hash(X.safe_log(text)).alias("line_hash"),
        X.content_hash(X.compact(text)).alias("compact_hash"),
        X.content_hash(X.tail(text)).alias("tail_hash"),
        X.short_id(X.content_hash(text)).alias("short_id"),
    )


@query(
    "json_escape", "P13",
    r"""SELECT conv_id, turn, sha256(replace(replace(replace(replace(text || chr(13) || '\"', '\', '\\'), '"', '\"'),
               chr(10), '\n'), chr(13), '\r')) AS escaped_hash FROM conversations""",
)
def json_escape(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("text"), F.lit('\r\\"'))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.content_hash(X.escape_json(raw)).alias("escaped_hash")
    )


@query(
    "engine_answer", "P29,S17",
    rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split_regex(raw, '\r\n|[\n\v\f\r\x{{85}}\x{{2028}}\x{{2029}}]')) AS line,
                          generate_subscripts(string_split_regex(raw, '\r\n|[\n\v\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS n
                   FROM (SELECT conv_id, turn, 'main: load' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Translation: ' ELSE '' END
                         || text || chr(10) || 'llama_print: done' || chr(10) AS raw FROM conversations)),
        s AS (SELECT conv_id, turn, n, {S.trim_low('line')} AS s FROM l),
        u AS (SELECT conv_id, turn, n, CASE WHEN strpos(s, ':') > 1 AND contains(lower(left(s, strpos(s, ':') - 1)), 'translation')
                     THEN {S.trim_low("substr(s, strpos(s, ':') + 1)")} ELSE s END AS a
              FROM s WHERE s <> '' AND NOT regexp_matches(lower(s), '^(main:|load:|decode:|llama_|system_info|model)'))
        SELECT c.conv_id, c.turn, sha256(coalesce(b.a, '')) AS answer_hash
        FROM conversations c LEFT JOIN (SELECT conv_id, turn, arg_max(a, n) AS a FROM u WHERE a <> '' GROUP BY ALL) b
             ON c.conv_id = b.conv_id AND c.turn = b.turn""",
)
def engine_answer(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(
        F.lit("main: load\n"),
        F.when(F.col("turn") % 2 == 0, "Translation: ").otherwise(""),
        F.col("text"),
        F.lit("\nllama_print: done\n"),
    )
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.content_hash(X.engine_answer(raw)).alias("answer_hash")
    )


@query(
    "printable_text", "P35,P50",
    r"""SELECT doc_id, sha256(list_aggregate(list_filter(string_split(raw, ''), lambda ch:
              NOT (unicode(ch) BETWEEN 57344 AND 63743 OR unicode(ch) BETWEEN 983040 AND 1048573
                   OR unicode(ch) BETWEEN 1048576 AND 1114109 OR unicode(ch) = 65533
                   OR (unicode(ch) < 32 AND unicode(ch) NOT IN (9, 10, 13)) OR unicode(ch) BETWEEN 127 AND 159)),
              'string_agg', '')) AS printable_hash, regexp_full_match(text, '[\x00-\x20]*') AS blank
        FROM (SELECT doc_id, text, text || chr(1) || chr(57344) || chr(65533) || chr(9) || chr(983041) || 'x' AS raw FROM documents)""",
)
def printable_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("text"), F.lit("\x01�\t\U000f0001x"))
    return table(spark, d, "documents").select(
        "doc_id",
        X.content_hash(X.sanitize_printable(raw)).alias("printable_hash"),
        X.is_blank(F.col("text")).alias("blank"),
    )


@query(
    "page_from_message", "P34,T5",
    r"""SELECT event_id, coalesce(try_cast(nullif(regexp_extract(m, '(?i)trang\s+(\d+)', 1), '') AS INTEGER),
                                 try_cast(nullif(regexp_extract(m, '(?i)page\s+(\d+)', 1), '') AS INTEGER), -1) AS page
        FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Error in Page ' || user_id
                     WHEN 1 THEN 'missing UNIT_3 trang ' || (event_id % 97) || ' page 5' ELSE event_type END AS m FROM events)""",
)
def page_from_message(spark: SparkSession, d: str) -> DataFrame:
    message = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Error in Page "), F.col("user_id")))
        .when(
            F.col("event_id") % 3 == 1,
            F.concat(F.lit("missing UNIT_3 trang "), F.col("event_id") % 97, F.lit(" page 5")),
        )
        .otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select("event_id", X.page_number(message).alias("page"))


@query(
    "should_translate_documents", "F1,P44,A2",
    f"""SELECT source, lang, count(*)::BIGINT AS docs,
               count(*) FILTER (WHERE {S.should_translate("attrs", 'plain')})::BIGINT AS translatable
        FROM (SELECT source, lang, {S.strip('text')} AS plain,
                     CASE doc_id % 7 WHEN 0 THEN ' class="Ref"' WHEN 1 THEN ' class="tsource1 x"'
                          WHEN 2 THEN ' id="preface"' ELSE '' END AS attrs FROM documents)
        GROUP BY source, lang""",
)
def should_translate_documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 7
    attrs = (
        F.when(k == 0, ' class="Ref"').when(k == 1, ' class="tsource1 x"')
        .when(k == 2, ' id="preface"').otherwise("")
    )
    plain = documents(spark, d).select(
        "doc_id", "source", "lang", attrs.alias("attrs"), X.strip_markup(F.col("text")).alias("plain")
    )
    return plain.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(PR.should_translate(F.col("attrs"), F.col("plain"))).alias("translatable"),
    )


@query(
    "text_layer", "S6,S7,F11,A2",
    f"""SELECT source AS title, count(*)::BIGINT AS page_count,
               count(*) FILTER (WHERE {S.trim_low('text')} <> '')::BIGINT AS text_pages,
               count(*) FILTER (WHERE {S.trim_low('text')} = '')::BIGINT AS empty_pages,
               bool_and({S.trim_low('text')} <> '') AS accepted
        FROM documents GROUP BY source""",
)
def text_layer(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.profile import page_text_profile

    return page_text_profile(documents(spark, d), "source", "text")
