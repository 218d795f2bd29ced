"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their
labels to other mentions in the same text.

Nodes are the matches of the patterns and all other words that hold a digit or an at sign.
Neighbouring nodes share a chain potential; nodes with the same digits or address, or with the
same last digits, share a skip potential, however far apart they are and however many there are:
each is joined with a match of the patterns itself. Loopy belief propagation
runs over the graphs of many texts at once. Matches of the patterns are observed; another node
becomes a span if its belief in one kind passes one half."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample, slices

# Kinds in their order, and the patterns that find them.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
MARK = re.compile(r"[0-9@]")

LABELS = len(KINDS) + 1  # 0: none of them
FEATURES = 16
#: Messages of a text that change by less are done.
SETTLED = 1e-3
#: Score of what an observed node is not; more than all messages of its repeats together.
NEVER = -1e9
#: Loops that never settle end here; a label needs no more than two edges to reach its repeats.
MOST_ROUNDS = 200
#: What is added to the counts of labels that meet on an edge.
PRIOR = 0.1
#: Rows (as expected, see ``sample``) whose counts the model is fitted to.
SAMPLE_ROWS = 20_000

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, in order; every pattern is read
    in time linear in the text.

    An address is found by its at sign: its local part is all that may stand before it, back
    to the match before."""
    found = []
    free = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = at = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]  # a part may be very long
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def words(text: str) -> Iterator[tuple[int, int]]:
    """Words that hold a digit or an at sign, without the punctuation around them."""
    end = 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        a, b = start, end
        while a < b and not text[a].isalnum() and text[a] not in "+@":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            yield a, b


@dataclass
class Graph:
    """Nodes of the texts of a slice, and the edges between them."""

    owner: list[int]
    span: list[tuple[int, int]]
    label: list[int]  # of the fixed patterns; 0: found by none
    bits: list[int]
    edges: list[tuple[int, int, int]]  # kind of edge, node, node
    pairs: list[tuple[int, int, int]]  # the same, for the counts: each node with the one before


def features(word: str, digits: str) -> int:
    """A bit for each property of a word's shape."""
    n = len(digits)
    at, dots = word.count("@"), word.count(".")
    tests = (
        n <= 3, 4 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        at == 1, at > 1, dots == 3, dots in (1, 2), word.startswith("+"), "-" in word,
        any(map(str.isalpha, word)), 12 <= n <= 19 and luhn(digits), at == 1 and dots > 0, True,
    )
    return sum(1 << i for i, t in enumerate(tests) if t)


def graph(texts: list[str]) -> Graph:
    """Chain edges (kind 0) join a node with the next one if they are not alike, skip edges join nodes that have the
    same digits or address (1) or the same last digits (2): each with the last match of the
    patterns before it and the next one behind it, or all with the first node where no pattern
    matches. Their number is linear in the text, also where one word is repeated all over."""
    out = Graph([], [], [], [], [], [])
    for number, text in enumerate(texts):
        if not MARK.search(text):
            continue
        base = base_spans(text)
        nodes = [(a, b, k + 1) for a, k, b in base]
        reach, i = 0, 0
        for a, b in words(text):
            while i < len(base) and base[i][0] < b:
                reach = max(reach, base[i][2])
                i += 1
            if a >= reach:
                nodes.append((a, b, 0))
        nodes.sort()
        groups: dict[tuple[int, str], list[int]] = {}
        like: set[tuple[int, str]] = set()
        for k, (a, b, label) in enumerate(nodes):
            word, me = text[a:b], len(out.owner)
            digits = DIGITS.sub("", word)
            out.owner.append(number)
            out.span.append((a, b))
            out.label.append(label)
            out.bits.append(features(word, digits))
            if k:
                out.pairs.append((0, me - 1, me))
            keys = [(1, word.casefold())] if "@" in word else [(1, digits)] * (len(digits) > 4)
            if len(digits) > 8 and "@" not in word:
                keys.append((2, digits[-8:]))
            if k and not like.intersection(keys):
                out.edges.append((0, me - 1, me))
            like = set(keys)
            for key in keys:
                groups.setdefault(key, []).append(me)
        for (kind, _), own in groups.items():
            out.pairs += [(kind, a, b) for a, b in zip(own, own[1:])]
            out.edges += [(kind, a, b) for a, b in skips(own, out.label)]
    return out


def skips(own: list[int], label: list[int]) -> Iterator[tuple[int, int]]:
    """Edges of a group of like nodes, none more than two away from any other's label."""
    if not any(label[i] for i in own):
        yield from ((own[0], i) for i in own[1:])
        return
    before, bare = None, []
    for i in own:
        if before is not None:
            yield before, i
        if label[i]:
            yield from ((b, i) for b in bare)
            before, bare = i, []
        else:
            bare.append(i)


@dataclass
class Model:
    weights: np.ndarray  # FEATURES x LABELS
    pairs: np.ndarray  # kind of edge x LABELS x LABELS, as logarithms


def fit(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from what the fixed patterns find in about ``rows`` rows of ``df``.

    Only counts reach the driver: how often each label meets each set of features (at most
    ``2 ** FEATURES * LABELS``) and how often labels meet on an edge (3 * 25). Node weights
    come from gradient ascent, edge potentials are the log odds of meeting against chance,
    with ``PRIOR`` added to the counts. An empty table gives a model that adds nothing."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], int] = {}
        for batch in slices(batches, text):
            g = graph([t or "" for t in batch.column(0).to_pylist()])
            for bits, label in zip(g.bits, g.label):
                sums[-1, bits, label] = sums.get((-1, bits, label), 0) + 1
            for kind, a, b in g.pairs:
                met = (kind, g.label[a], g.label[b])
                sums[met] = sums.get(met, 0) + 1
        rows = [(*k, n) for k, n in sums.items()]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["kind", "a", "b", "n"]
        )

    counted = (
        sample(df, key, rows).select(text)
        .mapInArrow(count, "kind long, a long, b long, n long")
        .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    )
    nodes = sorted((r.a, r.b, r.n) for r in counted if r.kind < 0)
    x = np.array([[bits >> i & 1 for i in range(FEATURES)] for bits, _, _ in nodes], float)
    x = x.reshape(len(nodes), FEATURES)
    n = np.array([c for _, _, c in nodes], float)
    y = np.zeros((len(nodes), LABELS))
    for i, (_, label, _) in enumerate(nodes):
        y[i, label] = 1
    weights = np.zeros((FEATURES, LABELS))
    weights[FEATURES - 1, 0] = 4.0
    for _ in range(400 if len(nodes) else 0):
        p = x @ weights
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights += 2.0 * (x.T @ ((y - p) * n[:, None])) / n.sum() - 1e-4 * weights
    met = np.full((3, LABELS, LABELS), PRIOR)
    for r in counted:
        if r.kind >= 0:
            met[r.kind, r.a, r.b] += r.n
            met[r.kind, r.b, r.a] += r.n
    met /= met.sum(axis=(1, 2), keepdims=True)
    alone = met.sum(axis=2)
    return Model(weights, np.log(met / (alone[:, :, None] * alone[:, None, :])))


def beliefs(g: Graph, model: Model) -> np.ndarray:
    """Marginals of all nodes by damped loopy message passing over all graphs at once, each
    until its own messages stop changing."""
    size = len(g.owner)
    x = (np.array(g.bits)[:, None] >> np.arange(FEATURES)) & 1
    unary = x @ model.weights
    label = np.array(g.label)
    seen = np.flatnonzero(label)
    unary[seen] = NEVER
    unary[seen, label[seen]] = 0.0
    if g.edges:
        edges = np.array(g.edges)
        kind = np.concatenate((edges[:, 0], edges[:, 0]))
        source = np.concatenate((edges[:, 1], edges[:, 2]))
        target = np.concatenate((edges[:, 2], edges[:, 1]))
        back = np.roll(np.arange(len(source)), len(edges))
        potential = model.pairs[kind]
        messages = np.zeros((len(source), LABELS))
        owner = np.array(g.owner)[source]
        on = np.arange(len(source))
        for _ in range(MOST_ROUNDS):
            total = unary.copy()
            np.add.at(total, target[on], messages[on])
            out = (total[source[on]] - messages[back[on]])[:, :, None] + potential[on]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            new = 0.5 * messages[on] + 0.5 * new
            change = np.zeros(owner.max() + 1)
            np.maximum.at(change, owner[on], np.abs(new - messages[on]).max(axis=1))
            messages[on] = new
            on = on[change[owner[on]] >= SETTLED]
            if not len(on):
                break
        np.add.at(unary, target, messages)
    unary -= unary.max(axis=1, keepdims=True)
    p = np.exp(unary)
    return p / p.sum(axis=1, keepdims=True) if size else p


def spans_of(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, found by a pattern) for each text, by start, then kind."""
    g = graph(texts)
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    if g.owner:
        p = beliefs(g, model)
        best = p[:, 1:].argmax(axis=1)
        sure = p[np.arange(len(p)), best + 1] > 0.5
        for i, number in enumerate(g.owner):
            a, b = g.span[i]
            if g.label[i]:
                out[number].append((a, g.label[i] - 1, b, True))
            elif sure[i]:
                out[number].append((a, int(best[i]), b, False))
    for own in out:
        own.sort()
    return out


def find(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``(key, spans)``: all spans of a text with kind, start, end (code points, end
    exclusive) and whether a fixed pattern found it. A null text has none. Row-local."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]
        ))
        for batch in slices(batches, text):
            found = spans_of([t or "" for t in batch.column(1).to_pylist()], model)
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": s} for a, k, b, s in own]
                for own in found
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, kind)], names=[key, "spans"]
            )

    name = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {name}, spans {SPANS}")


def redact(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; of spans that
    overlap, the first one's kind stands for all. A null text stays null; all other columns
    and the number of rows stay as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            out = []
            for t, own in zip(texts, spans_of([t or "" for t in texts], model)):
                parts, end = [], 0
                for a, k, b, _ in own:
                    if a >= end:
                        parts += [t[end:a], f"[{KINDS[k].upper()}]"]
                    end = max(end, b)
                out.append("".join([*parts, t[end:]]) if own else t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return df.mapInArrow(run, df.schema)


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
