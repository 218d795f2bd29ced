"""Model answers: chat and responses bodies, JSON items, UNIT markers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import bound
from . import patterns as P
from .text import clean_model_output, trim_low


def responses_text(body: Column) -> Column:
    """P25: ``output_text``, else the text parts joined by newline; null when absent."""
    direct = F.get_json_object(body, "$.output_text")
    output = F.from_json(
        F.get_json_object(body, "$.output"), "array<struct<content:array<struct<text:string>>>>"
    )
    parts = F.flatten(
        F.transform(
            output, lambda o: F.coalesce(o["content"], F.array().cast("array<struct<text:string>>"))
        )
    )
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    joined = F.array_join(texts, "\n")
    return clean_model_output(F.coalesce(direct, F.when(joined != "", joined)))


def _content_text(raw: Column) -> Column:
    """Text of a content value given as raw JSON or as a bare string."""
    as_object = F.coalesce(
        F.nullif(F.get_json_object(raw, "$.text"), F.lit("")),
        F.get_json_object(raw, "$.content"),
    )
    items = F.from_json(raw, "array<string>")
    texts = F.transform(
        items,
        lambda x: trim_low(
            F.coalesce(
                F.nullif(F.get_json_object(x, "$.text"), F.lit("")),
                F.get_json_object(x, "$.content"),
                F.when(x.startswith("{"), F.lit("")).otherwise(x),
                F.lit(""),
            )
        ),
    )
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    value = (
        F.when(raw.startswith("{") & raw.endswith("}"), as_object)
        .when(raw.startswith("[{") & raw.endswith("]"), joined)
        .otherwise(raw)
    )
    return F.nullif(trim_low(F.coalesce(value, F.lit(""))), F.lit(""))


def _text_at(body: Column, path: str) -> Column:
    """Text of the value at ``path``. A string is its own text, also one that looks like
    JSON; the type of the field decides, not its first characters."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))
    raw = F.get_json_object(body, path)
    own = F.nullif(trim_low(raw), F.lit(""))
    return F.when(kind == "STRING", own).otherwise(_content_text(raw))


def chat_text(body: Column) -> Column:
    """Text of the first choice, wherever the provider put it; null when the
    answer is missing or has only reasoning."""
    places = ("message.content", "text", "output_text")
    text = F.coalesce(*[_text_at(body, f"$.choices[0].{p}") for p in places])
    return F.when(
        F.get_json_object(body, "$.choices[0].message").isNotNull() & text.isNotNull(),
        clean_model_output(text),
    )


def reasoning_only(body: Column) -> Column:
    reasoning = _text_at(body, "$.choices[0].message.reasoning")
    return chat_text(body).isNull() & reasoning.isNotNull()


def build_markers(sources: Column, newline: str = "\n") -> Column:
    """Numbered blocks of a page in order."""
    return F.array_join(
        F.transform(
            sources,
            lambda s, i: F.concat(
                F.format_string(P.UNIT_MARKER_FORMAT, i), F.coalesce(s, F.lit(""))
            ),
        ),
        newline,
    )


def parse_markers(raw: Column, count: Column) -> Column:
    """Map number -> text from a marked answer. Numbers outside [0, count) are
    dropped, of a repeated number the last counts, a literal ``\\n`` is a newline."""
    raw = F.coalesce(raw, F.lit(""))
    ids = F.regexp_extract_all(raw, F.lit(P.UNIT_MARKER), F.lit(1))
    bodies = F.slice(F.split(raw, P.UNIT_MARKER, -1), F.lit(2), F.size(ids))
    entries = F.zip_with(
        ids, bodies,
        lambda i, b: F.struct(
            i.try_cast("int").alias("id"),
            trim_low(F.replace(b, F.lit("\\n"), F.lit("\n"))).alias("text"),
        ),
    )
    return last_wins(F.filter(entries, lambda e: (e["id"] >= 0) & (e["id"] < count)))


def last_wins(entries: Column) -> Column:
    """Map from (id, text) entries, the last of a repeated id kept.

    Sorted by id and place, an entry is the last of its id if the next one has another."""
    placed = F.transform(
        entries,
        lambda e, i: F.struct(e["id"].alias("id"), i.alias("place"), e["text"].alias("text")),
    )
    ordered = F.array_sort(placed)

    def kept(rows: Column) -> Column:
        last = F.filter(
            rows, lambda e, i: F.coalesce(F.get(rows, i + 1)["id"] != e["id"], F.lit(True))
        )
        return F.transform(last, lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text")))

    return F.map_from_entries(bound(ordered, kept))


def parse_items(raw: Column, count: Column) -> Column:
    """Map number -> translation from a JSON array inside an answer; empty
    translations, ids that are no number or out of range are skipped."""
    first = F.instr(raw, "[")
    last = F.length(raw) - F.instr(F.reverse(raw), "]") + 1
    items = F.from_json(
        F.substring(raw, first, last - first + 1), "array<struct<id:string,translation:string>>"
    )
    entries = F.transform(
        items,
        lambda x: F.struct(
            F.when(x["id"].rlike(r"^[+-]?\d+$"), x["id"]).try_cast("int").alias("id"),
            trim_low(x["translation"]).alias("text"),
        ),
    )
    return last_wins(
        F.filter(entries, lambda e: (e["text"] != "") & (e["id"] >= 0) & (e["id"] < count))
    )


def id_texts(raw: Column) -> Column:
    """C4: (id, translation) entries of a batch answer, both present."""
    from .text import json_array_slice

    items = F.from_json(json_array_slice(raw), "array<struct<id:string,translation:string>>")
    return F.filter(items, lambda x: (x["id"] != "") & (x["translation"] != ""))


def line_items(prompt: Column) -> Column:
    """P33, the usual case: one JSON object with id and source per line."""
    lines = F.transform(F.split(prompt, r"\R", -1), trim_low)
    objects = F.transform(
        lines,
        lambda x: F.from_json(
            F.regexp_extract(x, r"(?s)\{.*\}", 0), "struct<id:string,source:string>"
        ),
    )
    return F.filter(
        objects, lambda o: o.isNotNull() & o["id"].isNotNull() & o["source"].isNotNull()
    )


def embedded_objects(prompt: str | None) -> list[dict] | None:
    """Objects with id and source anywhere in a text: at each brace one JSON value is read,
    and the search goes on behind it."""
    if prompt is None:
        return None
    decoder = json.JSONDecoder()  # not at module level: the package is pickled by value
    out = []
    at = prompt.find("{")
    while at >= 0:
        try:
            item, end = decoder.raw_decode(prompt, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            if "id" in item and "source" in item:
                out.append({"id": str(item["id"]), "source": str(item["source"])})
        at = prompt.find("{", end)
    return out


_ITEM = T.StructType().add("id", "string").add("source", "string")


@F.pandas_udf(T.ArrayType(_ITEM))
def embedded_items(prompts: pd.Series) -> pd.Series:
    """P33, recovery prompts: objects anywhere in the text; null for a null prompt."""
    return prompts.map(embedded_objects)


def prompt_items(prompt: Column) -> Column:
    """Per line when that finds any, anywhere otherwise."""
    lines = line_items(prompt)
    rest = embedded_items(F.when(F.size(lines) == 0, prompt))  # null where lines answer
    return F.when(F.size(lines) > 0, lines).otherwise(rest)


def model_catalog(body: Column) -> Column:
    """(id, label) of text models that can generate content."""
    models = F.from_json(
        F.get_json_object(body, "$.models"),
        "array<struct<name:string,displayName:string,description:string,"
        "supportedGenerationMethods:array<string>>>",
    )
    named = F.transform(
        models, lambda m: m.withField("id", F.regexp_replace(m["name"], "^models/", ""))
    )

    def usable(m: Column) -> Column:
        low = F.lower(m["id"])
        bad = F.lit(False)
        for w in P.MODEL_EXCLUDED:
            bad = bad | F.contains(low, F.lit(w))
        generates = F.exists(
            m["supportedGenerationMethods"], lambda x: F.lower(x) == "generatecontent"
        )
        return F.coalesce(generates, F.lit(False)) & low.startswith("gemini-") & ~bad

    def label(m: Column) -> Column:
        preview = F.contains(F.lower(F.coalesce(m["description"], F.lit(""))), F.lit("preview"))
        preview = preview | F.contains(F.lower(m["id"]), F.lit("preview"))
        return F.struct(
            m["id"].alias("id"),
            F.concat(
                F.coalesce(m["displayName"], m["id"]), F.when(preview, " — PREVIEW").otherwise("")
            ).alias("label"),
        )

    return F.transform(F.filter(named, usable), label)
