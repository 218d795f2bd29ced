"""DuckDB spellings of the text expressions, for the oracle side only.

RE2 has neither lookaround nor backreferences, so several patterns are written
differently from their Spark counterparts; that independence is the point."""

FENCE = "```"
WORD_CHARS = r"[\p{L}\p{M}\p{N}_]"


def trim_low(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def strip(x: str) -> str:
    return trim_low(
        rf"regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'),"
        rf" '&[a-zA-Z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')"
    )


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def sentence_count(x: str) -> str:
    return (
        rf"(CASE WHEN {trim_low(x)} = '' THEN 0 ELSE greatest(1, {count(x, r'[.!?](\s|$)')}) END)"
    )


def split_sentences(x: str) -> str:
    marked = rf"regexp_replace({trim_low(x)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)),"
        f" lambda p: {trim_low('p')}), lambda p: p <> '')"
    )


def english_words(x: str) -> str:
    return (
        f"len(list_filter(regexp_extract_all({x}, '{WORD_CHARS}+'),"
        " lambda w: regexp_full_match(w, '[A-Za-z]{3,}')))"
    )


def vietnamese_words(x: str) -> str:
    return count(x, "[À-ỹĐđ]{2,}")


def has_vietnamese(x: str) -> str:
    return (
        f"regexp_matches({x}, '[ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠàáâãèéêìíòóôõùúăđĩũơƯưẠ-ỹ]')"
    )


def important_tokens(x: str) -> str:
    core = (
        r"\d+(?:[.,]\d+)?(?:–|-|to)\d+(?:[.,]\d+)?%?|\d+(?:[.,]\d+)?%|\d+:[0-9]+"
        r"|[A-Z]{2,}\d*(?:[.-]\d+)+"
    )
    doubled = rf"regexp_replace({x}, '(\s)', '\1\1', 'g')"
    return (
        f"list_transform(regexp_extract_all({doubled},"
        f" '(?i)(?:^|[^A-Za-z0-9])({core})(?:[^A-Za-z0-9]|$)', 1), lambda t: lower(t))"
    )


def drop_fence(x: str, label: str = "html|xml") -> str:
    t = trim_low(f"coalesce({x}, '')")
    body = (
        rf"regexp_replace(regexp_replace({t}, '^{FENCE}(?:{label})?\s*', ''), '\s*{FENCE}$', '')"
    )
    return f"(CASE WHEN starts_with({t}, '{FENCE}') THEN {body} ELSE {t} END)"


def should_translate(attrs: str, plain: str) -> str:
    denied = (
        f"(len(list_filter(regexp_extract_all(lower(coalesce({attrs}, '')), '{WORD_CHARS}+'),"
        " lambda w: list_contains(['ref','ref1','reflist','references','bibliography','bib','doi',"
        "'url','tsource','tsource1','figcredit','fignum'], w))) > 0"
        rf" AND NOT regexp_matches(lower(coalesce({attrs}, '')), '[\n\r\x{{85}}\x{{2028}}\x{{2029}}]'))"
    )
    compact = f"regexp_replace({plain}, '[^A-Za-z0-9-]', '', 'g')"
    low = f"lower({trim_low(plain)})"
    return (
        rf"((length({plain}) >= 2 OR strlen({plain}) >= 4) AND regexp_matches({plain}, '\p{{L}}')"
        f" AND NOT {denied}"
        f" AND NOT (length({compact}) <= 10 AND regexp_full_match({compact}, '[A-Za-z][A-Za-z0-9-]+')"
        f" AND NOT ({low} IN ('definition','feature','renal','seizure','prenatal','classic signs',"
        rf"'key points','references') OR regexp_full_match({low}, 'table\s+129\.[0-9]+')))"
        f" AND NOT ({has_vietnamese(plain)} AND {english_words(plain)}"
        f" < greatest(3, {vietnamese_words(plain)} * 2)))"
    )


MARKUP = r"(?is)<!--.*?-->|<[^>]+>|&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"


def protect(x: str) -> str:
    gaps = f"string_split_regex({x}, '{MARKUP}')"
    tokens = f"regexp_extract_all({x}, '{MARKUP}')"
    return (
        f"list_aggregate(list_transform({gaps}, lambda g, i: g || CASE WHEN i <= len({tokens})"
        " THEN '__KEEP_MARKUP_' || CASE WHEN i - 1 < 1000 THEN lpad((i - 1)::VARCHAR, 3, '0')"
        " ELSE (i - 1)::VARCHAR END || '__' ELSE '' END), 'string_agg', '')"
    )


def _alternatives(tags: str) -> str:
    return "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in tags.split())


BLOCKS = _alternatives(
    "p h1 h2 h3 h4 h5 h6 figcaption caption th td li blockquote dt dd pre address"
)
CONTAINERS = _alternatives("div section article aside")
ANY_BLOCK = (
    r"(?i)<(?:p|h[1-6]|figcaption|caption|th|td|li|blockquote|dt|dd|pre|address"
    r"|div|section|article|aside)\b"
)

FILE = "'OEBPS/page' || page_id || '.xhtml'"


def _family(name: str, pattern: str) -> str:
    return f"""{name}_m AS (SELECT page_id, regexp_extract_all(html, '{pattern}') AS ms,
                          string_split_regex(html, '{pattern}') AS gs FROM pages),
        {name}_x AS (SELECT page_id, unnest(ms) AS m,
                 unnest(list_transform(ms, lambda x, i: list_sum(list_transform(gs[1:i], lambda g: length(g)))
                        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))) AS start_at FROM {name}_m),
        {name} AS (SELECT page_id, start_at::INTEGER AS start_at, (start_at + length(m))::INTEGER AS end_at, t AS tag,
                 substr(m, length(t) + 2, strpos(m, '>') - length(t) - 2) AS attrs,
                 substr(m, strpos(m, '>') + 1, length(m) - strpos(m, '>') - length(t) - 3) AS inner_html
               FROM (SELECT *, regexp_extract(m, '^<([A-Za-z0-9]+)', 1) AS t FROM {name}_x))"""


UNITS = f"""{_family('blocks', BLOCKS)}, {_family('boxes', CONTAINERS)},
        cands AS (SELECT * FROM blocks UNION ALL
                  SELECT * FROM boxes WHERE NOT regexp_matches(inner_html, '{ANY_BLOCK}')),
        ord AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY start_at) - 1 AS ordinal,
                {FILE} AS file, sha256(inner_html) AS source_hash, {strip('inner_html')} AS plain FROM cands),
        units AS (SELECT *, sha256(file || '|' || ordinal || '|' || source_hash) AS id,
                  {should_translate('attrs', 'plain')} AS translatable FROM ord)"""
