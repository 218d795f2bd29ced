"""Text columns: stripping, counting, tokens, sentences, model-output clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

FENCE = "```"
_LOW = "".join(chr(i) for i in range(33))


def trim_low(c: Column) -> Column:
    """Trim every character up to U+0020, not just blanks."""
    return F.btrim(c, F.lit(_LOW))


def is_blank(c: Column) -> Column:
    """P50: null, empty and whitespace-only all count as blank."""
    return trim_low(F.coalesce(c, F.lit(""))) == ""


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: one more per character outside the BMP."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def strip_markup(c: Column) -> Column:
    """Visible text of a fragment, whitespace collapsed."""
    c = F.regexp_replace(c, P.TAG, " ")
    c = F.regexp_replace(c, P.ENTITY, " ")
    return trim_low(F.regexp_replace(c, r"\s+", " "))


def drop_fence(c: Column, label: str = "html|xml") -> Column:
    """Drop a leading code fence (with one of the labels) and the closing one."""
    t = trim_low(F.coalesce(c, F.lit("")))
    body = F.regexp_replace(t, f"^{FENCE}(?:{label})?\\s*", "")
    body = F.regexp_replace(body, f"\\s*{FENCE}$", "")
    return F.when(t.startswith(FENCE), body).otherwise(t)


def clean_fragment(c: Column, cut_prose: bool = False) -> Column:
    """Fence removal. ``cut_prose`` also cuts to first ``<`` .. last ``>``
    when prose precedes the first tag, which loses text; it is off by default."""
    t = drop_fence(c)
    if not cut_prose:
        return t
    first = F.instr(t, "<")
    last = F.length(t) - F.instr(F.reverse(t), ">") + 1
    found = (first > 1) & (F.instr(t, ">") > 0) & (last > first)
    return F.when(found, trim_low(F.substring(t, first, last - first + 1))).otherwise(t)


def clean_model_output(c: Column) -> Column:
    """Fence removal, trimmed on both ends."""
    return trim_low(drop_fence(c))


def json_array_slice(c: Column) -> Column:
    """From the first ``[`` to the last ``]``; null when there is none."""
    t = drop_fence(c, "json")
    first = F.instr(t, "[")
    last = F.length(t) - F.instr(F.reverse(t), "]") + 1
    ok = (first > 0) & (F.instr(t, "]") > 0) & (last > first)
    return F.when(ok, F.substring(t, first, last - first + 1))


def sentence_count(c: Column) -> Column:
    """0 for blank text, otherwise at least 1."""
    n = F.regexp_count(c, F.lit(P.SENTENCE_END))
    return F.when(is_blank(c), F.lit(0)).otherwise(F.greatest(F.lit(1), n))


def split_sentences(c: Column) -> Column:
    """Sentences in order, trimmed, empties dropped."""
    parts = F.split(trim_low(F.coalesce(c, F.lit(""))), P.SENTENCE_SPLIT, -1)
    return F.filter(F.transform(parts, trim_low), lambda x: x != "")


def important_tokens(c: Column) -> Column:
    """Numbers with a range, percent or ratio and dotted codes, lower-cased."""
    hits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(P.IMPORTANT_TOKEN), F.lit(0))
    return F.transform(hits, F.lower)


def multiset_cover(need: Column, have: Column) -> Column:
    """How many of ``need`` (an array) also occur in ``have``, as multisets.

    Both are sorted together, so equal tokens are neighbours and one fold counts them."""

    def marked(tokens: Column, a: int, b: int) -> Column:
        return F.transform(
            tokens, lambda t: F.struct(t.alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        )

    def step(acc: Column, x: Column) -> Column:
        same = acc["t"] == x["t"]
        return F.struct(
            x["t"].alias("t"),
            (x["a"] + F.when(same, acc["a"]).otherwise(0)).alias("a"),
            (x["b"] + F.when(same, acc["b"]).otherwise(0)).alias("b"),
            (acc["n"] + F.when(same, 0).otherwise(F.least(acc["a"], acc["b"]))).alias("n"),
        )

    zero = F.struct(
        F.lit("").alias("t"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n")
    )
    tokens = F.sort_array(F.concat(marked(need, 1, 0), marked(have, 0, 1)))
    return F.aggregate(tokens, zero, step, lambda acc: acc["n"] + F.least(acc["a"], acc["b"]))


def english_words(c: Column) -> Column:
    """P10."""
    return F.regexp_count(c, F.lit(P.ENGLISH_WORD))


def vietnamese_words(c: Column) -> Column:
    """P11."""
    return F.regexp_count(c, F.lit(P.VIETNAMESE_WORD))


def has_vietnamese(c: Column) -> Column:
    """P12."""
    return c.rlike(P.VIETNAMESE_MARK)


def escape_json(c: Column) -> Column:
    """Backslash, quote, LF and CR only."""
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def content_hash(c: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(c, 256)


def unit_id(file: Column, ordinal: Column, source_hash: Column) -> Column:
    """Identity of a unit: file, ordinal and content hash."""
    return content_hash(F.concat_ws("|", file, ordinal.cast("string"), source_hash))


def normalize_path(c: Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments, never above the root."""
    parts = F.filter(F.split(c, "/", -1), lambda x: ~x.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, x)),
    )
    return F.array_join(kept, "/")


def safe_key(c: Column) -> Column:
    """A name usable as a file name."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def safe_log(c: Column) -> Column:
    """One log field on one line."""
    return F.translate(F.coalesce(c, F.lit("")), "\n\r|", "  /")


def short_id(c: Column) -> Column:
    return F.left(F.coalesce(c, F.lit("")), F.lit(12))


def compact(c: Column) -> Column:
    """Collapse whitespace, cut at 1200 characters."""
    t = trim_low(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > 1200, F.concat(F.left(t, F.lit(1200)), F.lit("…"))).otherwise(t)


def tail(c: Column) -> Column:
    """P28."""
    return F.right(c, F.lit(1000))


def engine_answer(c: Column) -> Column:
    """Last non-empty line of engine output that is not a log line."""
    lines = F.transform(F.split(c, r"\R", -1), trim_low)
    lines = F.filter(
        lines,
        lambda s: (s != "") & ~F.lower(s).rlike("^(?:" + "|".join(P.ENGINE_LOG_PREFIXES) + ")"),
    )

    def unlabel(s: Column) -> Column:
        colon = F.instr(s, ":")
        label = F.lower(F.substring(s, F.lit(1), colon - 1))
        return F.when(
            (colon > 1) & F.contains(label, F.lit("translation")),
            trim_low(F.substring(s, colon + 1, F.length(s))),
        ).otherwise(s)

    answers = F.filter(F.transform(lines, unlabel), lambda s: s != "")
    return F.coalesce(F.try_element_at(answers, F.lit(-1)), F.lit(""))


def page_number(c: Column) -> Column:
    """Page named in a message, -1 when there is none."""
    found = [
        F.regexp_extract(c, rf"(?i){word}\s+(\d+)", 1).try_cast("int") for word in ("trang", "page")
    ]
    return F.coalesce(*found, F.lit(-1))


def sanitize_printable(c: Column) -> Column:
    """Drop private-use, replacement and control characters."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), P.UNPRINTABLE, "")


def is_footer(text: Column, y: Column, page_height: Column) -> Column:
    """Near the bottom edge or carrying a publisher line."""
    low = F.lower(trim_low(text))
    words = F.lit(False)
    for w in P.FOOTER_WORDS:
        words = words | F.contains(low, F.lit(w))
    edge = page_height.cast("float") - F.lit(35.0).cast("float")
    return text.isNotNull() & ((y > edge) | words)


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percent, 0 while the total is unknown."""
    return F.when(total <= 0, F.lit(0)).otherwise(F.floor(F.lit(100.0) * done / total).cast("int"))


def chunk_long_text(c: Column, limit: int = P.CHUNK_CHARS) -> Column:
    """Pack sentences greedily into chunks of at most ``limit`` characters.

    Only texts above the limit are split, after ``.!?;:`` and whitespace; a
    single longer sentence stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        full = (F.length(cur) > 0) & (F.length(cur) + F.length(s) + 1 > limit)
        joined = F.when(F.length(cur) > 0, F.concat(cur, F.lit(" "), s)).otherwise(s)
        return F.struct(
            F.when(full, F.array_append(out, cur)).otherwise(out).alias("out"),
            F.when(full, s).otherwise(joined).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])

    packed = F.aggregate(F.split(c, P.CHUNK_SPLIT, -1), empty, step, finish)
    return F.when((F.length(c) <= limit) | (F.size(packed) == 0), F.array(c)).otherwise(packed)
