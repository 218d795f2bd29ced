"""The small per-prompt helpers that let a plain text translator, such as a
local engine, serve the prompts of this package."""

from __future__ import annotations

import json
from collections.abc import Callable

import regex

from ..functions import patterns as P
from ..functions.response import embedded_objects

_MARKUP = regex.compile(P.MARKUP + "|" + P.PLACEHOLDER)
_MARKER = regex.compile(P.UNIT_MARKER)
_LETTER = regex.compile(r"\p{L}")
_SPLIT = regex.compile(P.CHUNK_SPLIT)


def chunks(text: str, limit: int = P.CHUNK_CHARS) -> list[str]:
    """W3 on one string."""
    if len(text) <= limit:
        return [text]
    out: list[str] = []
    for sentence in _SPLIT.split(text):
        if out and len(out[-1]) + len(sentence) + 1 <= limit:
            out[-1] += " " + sentence
        else:
            out.append(sentence)
    return out


def translate_markup(source: str, translate_text: Callable[[str], str]) -> str:
    """Translate only the letters between markup; long runs go in chunks, joined by
    a blank."""
    out, at = [], 0

    def piece(text: str) -> str:
        if not _LETTER.search(text):
            return text
        return " ".join(translate_text(c) if _LETTER.search(c) else c for c in chunks(text))

    for m in _MARKUP.finditer(source):
        out += [piece(source[at : m.start()]), m.group()]
        at = m.end()
    return "".join(out) + piece(source[at:])


def prompt_adapter(translate_text: Callable[[str], str]) -> Callable[[str, str], str]:
    """A translator for prompts with JSON items, with unit markers, or with the
    fragment after the last blank line."""

    def translate(prompt: str, context: str) -> str:
        items = [i for line in prompt.splitlines() for i in embedded_objects(line)] or embedded_objects(prompt)
        items = [i for i in items if i["id"] and i["source"]]
        if items:
            done = [
                {"id": i["id"], "translation": translate_markup(i["source"], translate_text)}
                for i in items
            ]
            return json.dumps(done, ensure_ascii=False)
        marks = list(_MARKER.finditer(prompt))
        if marks:
            ends = [m.start() for m in marks[1:]] + [len(prompt)]
            return "\n".join(
                P.UNIT_MARKER_FORMAT % int(m.group(1))
                + translate_markup(prompt[m.end() : end].strip(), translate_text)
                for m, end in zip(marks, ends)
            )
        fragment = prompt.rpartition("\n\n")[2].strip()
        if not _LETTER.search(fragment):
            raise ValueError("no JSON items, unit markers or fragment in the prompt")
        return translate_markup(fragment, translate_text)

    return translate
