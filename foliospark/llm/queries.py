"""Registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontaminate, hard_negatives, html, jaccard, langid, mtree, pii, pivots, sentences, substrings,
    toxicity, variants,
)
from .common import fold

#: Name -> plan(spark, sf_dir).
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Name -> DuckDB SQL, where SQL can express the query.
SQL: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]):
    QUERIES[plan.__name__] = plan
    return plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Place of the byte-level vocabulary and the pattern that splits a text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; counts and digests."""
    return bpe.roundtrip(table(spark, sf_dir, "documents"), "doc_id", "text", *vocabulary())


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; a quarter of the rows, chosen by checksum, is held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2), "text", "lang")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    found = langid.predict(docs, "doc_id", "text", model)
    return found.select("doc_id", held, "lang_pred", "score")


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, "doc_id", "text", pii.fit(docs, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
        for k in pii.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.shown(base), 256).alias("base_sha256"),
        pii.shown(F.col("spans")).alias("spans"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, size, toxic)`` of labelled documents of the folds that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = labels.filter((fold("doc_id", 5) != 0) & F.col("toxic").isin(0, 1))
    # Measured below the join, which may be a shuffle.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("size"))
    return docs.join(labels, "doc_id")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(labelled(spark, sf_dir), "doc_id", "text", "toxic", size="size")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; a fifth of the rows, chosen by checksum, is held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    found = toxicity.score(docs, "doc_id", "text", toxicity_model(spark, sf_dir))
    return found.select("doc_id", held, "score", "predicted", "spans")


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.with_text(pages, "html", html.fit(pages, "page_id", "html"))
    return found.select(
        "page_id", "url", F.col("html").alias("text"), F.length("html").cast("long").alias("n_chars")
    )


@query
def op6_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, and the best alignment of each."""
    found = decontaminate.overlaps(
        table(spark, sf_dir, "documents"), "doc_id", "text",
        table(spark, sf_dir, "benchmark"), "item_id", "text",
    )
    return found.drop("_row")


#: Of four parts of three tokens, one is equal in every span with nine of twelve equal tokens, so
#: equal parts lead to all of them. All items of the given tables are at least as long as the
#: span; shorter ones are tested against a brute-force version only.
SQL["op6_benchmark_overlap"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, w, row_number() OVER () AS r FROM (SELECT DISTINCT doc_id, text, list_filter(
    string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
), b AS MATERIALIZED (
  SELECT min(item_id) AS item_id, bw FROM (SELECT item_id, list_filter(
    string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS bw FROM benchmark)
  WHERE len(bw) >= 5 GROUP BY bw
), ds AS (SELECT r, x, w[x] || ' ' || w[x + 1] || ' ' || w[x + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS x FROM d)),
bs AS (SELECT item_id, y, bw[y] || ' ' || bw[y + 1] || ' ' || bw[y + 2] AS g FROM (SELECT *, unnest(range(1, len(bw) - 1)) AS y FROM b)),
hit AS (
  SELECT DISTINCT r, item_id, x - o AS p, y - o AS q FROM ds JOIN bs USING (g), (VALUES (0), (3), (6), (9)) AS t(o)
), same AS (
  SELECT d.r, doc_id, b.item_id, p - q AS shift,
    len(list_filter(range(0, 12), lambda i: w[p + i] = bw[q + i])) AS agree,
    len(list_filter(range(greatest(-12, 1 - p, 1 - q), least(24, len(w) - p + 1, len(bw) - q + 1)),
      lambda i: w[p + i] = bw[q + i])) AS around,
    least(24, len(w) - p + 1, len(bw) - q + 1) - greatest(-12, 1 - p, 1 - q) AS seen
  FROM hit JOIN d ON d.r = hit.r JOIN b ON b.item_id = hit.item_id
  WHERE p >= 1 AND q >= 1 AND p + 11 <= len(w) AND q + 11 <= len(bw)
)
SELECT doc_id, item_id, count(DISTINCT shift) AS n_places,
  max((around, seen))[1] AS best_agree, max((around, seen))[2] AS best_seen
FROM same WHERE agree >= 9 GROUP BY doc_id, r, item_id
"""


@query
def op1_sentence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the sentence runs that stand earlier in the corpus."""
    return sentences.dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


SQL["op8_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles overlap by three quarters."""
    return jaccard.linked(table(spark, sf_dir, "documents"), "doc_id", "text")


#: ``shingles`` of fewer than five words are the whole text; components by a recursive walk.
SQL["op10_shingle_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the 50-byte strings that an earlier text holds; digests."""
    return substrings.dedup(table(spark, sf_dir, "documents"), "doc_id", "text").drop("kept")


@query
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return pivots.near_copies(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


#: Every pair of one label; the operator finds all of them in the given tables.
SQL["op11_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r(vec_id, m) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.vec_id
), c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that score between 80 and 100 hundredths of a positive of every 100th vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(vectors, "vec_id", moved, "embedding", F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (
    PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, the more frequent word each is one edit from, and where these lead."""
    words = variants.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")
    return variants.forms(words).select("word", "n", "n_near", "form", "form_n", "root")


#: Words that differ by one letter are equal once it is deleted. The checksum is computed bit by
#: bit from the reversed polynomial of crc32.
SQL["op13_spelling_variants"] = """
WITH RECURSIVE r AS (
  SELECT hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS k, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL
), t AS MATERIALIZED (
  SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS t FROM range(0, 256) AS x(b)
), y AS (
  SELECT run, n, list_transform(range(0, len(k) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', k[2 * i + 1]) - 1)
    + strpos('0123456789ABCDEF', k[2 * i + 2]) - 1) AS bytes FROM r
), m AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM y, t
), u AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM m
), w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM u WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), d AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), e AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.cut = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.cut = w.word
), f AS (
  SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM e GROUP BY word
), g AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
  FROM w LEFT JOIN f ON f.word = w.word
), s(word, reached, step) AS (
  SELECT word, word, 0 FROM g UNION ALL SELECT s.word, g.form, step + 1 FROM s JOIN g ON g.word = s.reached WHERE g.form IS NOT NULL
)
SELECT g.word, n, n_near, form, form_n, root FROM g
JOIN (SELECT word, arg_max(reached, step) AS root FROM s GROUP BY word) x ON x.word = g.word
"""
