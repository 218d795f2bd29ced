"""Toxic spans by a linear-chain conditional random field, and document scores from them.

A chain is a sentence. Its tokens are toxic or not; a token's potential comes from its word,
the word's beginnings and the words beside it, and neighbours share a transition. Forward and
backward passes give the marginals of all chains of a slice at once. Labels are known for
documents only, so the tokens of labelled documents are tagged first: in a toxic document, a
word is toxic if it, or its beginning, stands in toxic documents far more than chance allows."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")
#: Documents of the sample that a feature stands in at least.
LEAST_DOCUMENTS = 4
#: Beginnings of a word, in characters, that count as its features.
BEGINNINGS = (4, 5)
#: Least log-likelihood ratio of a feature of toxic words; about one chance in 10 ** 5.
LEAST_RATIO = 20.0
#: Labelled rows, toxic and other, that the model is fitted to, and the most bytes of their
#: texts: the driver holds them while it learns.
SAMPLE_ROWS, SAMPLE_BYTES = (600, 1_500), (1_500_000, 3_500_000)
STEPS = 30
#: Words that a worker remembers; beyond it the memory is emptied.
WORDS = 400_000

SPANS = "array<struct<start:int,end:int,score:double>>"


def bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode("utf-8", "surrogatepass"))


def own_features(word: str) -> tuple[int, ...]:
    low = word.lower()
    return (bucket("w", low), *(bucket(f"b{n}", low[:n]) for n in BEGINNINGS))


def features(word: str) -> tuple[int, ...]:
    """Checksums of a word as itself, as the one before and as the one after."""
    low = word.lower()
    return (*own_features(word), bucket("<", low), bucket(">", low))


@dataclass
class Model:
    names: np.ndarray  # checksums of the features that count, in order
    weights: np.ndarray  # of each feature, for toxic against other; the last: of all others, 0
    bias: float
    transition: np.ndarray  # 2 x 2, from and to; 1: toxic
    scale: tuple[float, float, float]  # score = logistic(a + b * log(mass) + c * log(tokens))


def places(names: np.ndarray, words) -> np.ndarray:
    """Place of each feature of each word among ``names``; their number if it is not there."""
    wanted = np.array(words, np.int64).reshape(len(words), 3 + len(BEGINNINGS))
    at = np.searchsorted(names, wanted)
    if not len(names):
        return at
    return np.where(names[np.minimum(at, len(names) - 1)] == wanted, at, len(names))


class Chains:
    """Tokens of many texts, cut into chains, with the length of each."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, texts: np.ndarray):
        """``ids``: word of each token or -1 for an end of a sentence; ``texts``: whose."""
        self.word = np.flatnonzero(~ends)
        self.ids, self.text = ids[self.word], texts[self.word]
        n = len(self.word)
        group = np.cumsum(ends)[self.word]
        new = np.ones(n, bool)
        if n:
            new[1:] = (group[1:] != group[:-1]) | (self.text[1:] != self.text[:-1])
        self.new = new
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, n))
        order = np.argsort(-length, kind="stable")
        self.start, self.length = start[order], length[order]
        longest = int(self.length[0]) if len(start) else 0
        # How many chains have a token at this place.
        self.active = np.searchsorted(-self.length, -np.arange(longest), side="left")

    def ratios(self, odds: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic against other, of what comes up to each token and of what comes after it."""
        (oo, ot), (to, tt) = np.exp(transition)
        forward, backward = odds.copy(), np.ones(len(odds))
        for t in range(1, len(self.active)):
            at = self.start[: self.active[t]] + t
            r = forward[at - 1]
            forward[at] = odds[at] * np.clip((r * tt + ot) / (r * to + oo), 1e-30, 1e30)
        for t in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[t]] + t
            r = odds[at] * backward[at]
            backward[at - 1] = np.clip((tt * r + to) / (ot * r + oo), 1e-30, 1e30)
        return forward, backward

    def potentials(self, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Odds of each token, from its word and its neighbours in the chain."""
        e = own[self.ids]
        if len(e):
            inner = ~self.new[1:]
            e[1:] += np.where(inner, before[self.ids[:-1]], 0)
            e[:-1] += np.where(inner, after[self.ids[1:]], 0)
        return np.exp(np.clip(e, -30, 30))


def mass(p: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text, minus the log of the chance that no token is toxic."""
    return np.bincount(text, weights=-np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=texts)


def log_ratio(t: int, c: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a feature in t toxic and c clean documents; 0 if not toxic."""
    share = toxic / (toxic + clean)
    if t / max(t + c, 1) <= share:
        return 0.0
    found = t / (t + c)
    out = t * math.log(found / share)
    return 2 * (out + (c * math.log((1 - found) / (1 - share)) if c else 0))


def tell_apart(
    ids: np.ndarray, owner: np.ndarray, word: np.ndarray, label: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Features that stand in enough texts, in order, and which of them are toxic (one more
    entry stands for all others). A word's use as a neighbour counts like the word."""
    plain = ids >= 0
    met = np.unique(owner[plain] * len(word) + ids[plain])  # (text, word) pairs
    text, of = met // len(word), met % len(word)
    toxic, clean = int(label.sum()), int(len(label) - label.sum())
    names, strong = [], []
    for j in range(word.shape[1]):
        feature, at = np.unique(word[:, j], return_inverse=True)
        pairs = np.unique(text * len(feature) + at[of])
        hit = label[pairs // len(feature)] == 1
        t = np.bincount(pairs[hit] % len(feature), minlength=len(feature))
        c = np.bincount(pairs[~hit] % len(feature), minlength=len(feature))
        often = np.flatnonzero(t + c >= LEAST_DOCUMENTS)
        names.append(feature[often])
        strong.append(
            np.array([log_ratio(int(t[i]), int(c[i]), toxic, clean) >= LEAST_RATIO for i in often], bool)
        )
    names, first = np.unique(np.concatenate(names), return_index=True)
    return names, np.append(np.concatenate(strong)[first], False)


def learn(texts: list[str], labels: list[int]) -> Model:
    """Tag the tokens of labelled texts, then fit the field to the tags (AdaGrad) and the
    document scale to the labels."""
    number: dict[str, int] = {}
    ids, lengths = array("i"), array("i")
    for text in texts:
        found = TOKEN.findall(text)
        ids.extend(-1 if w in ENDS else number.setdefault(w, len(number)) for w in found)
        lengths.append(len(found))
    token_ids = np.array(ids, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.array(lengths, np.int64))
    word = np.array([features(w) for w in number], np.int64).reshape(len(number), 3 + len(BEGINNINGS))
    label = np.array(labels)
    toxic, clean = int(label.sum()), int(len(label) - label.sum())
    transition = np.zeros((2, 2))
    if not toxic or not clean or not number:
        none = np.zeros(0, np.int64), np.zeros(1)
        return Model(*none, -10.0, transition, (-10.0 if not toxic else 0.0, 0.0, 0.0))
    names, strong = tell_apart(token_ids, owner, word, label)
    buckets = len(names) + 1
    weights = np.zeros(buckets)
    word = places(names, word)
    hot = strong[word[:, : 1 + len(BEGINNINGS)]].any(axis=1)
    chains = Chains(token_ids, token_ids < 0, owner)
    y = (hot[chains.ids] & (label[chains.text] == 1)).astype(float)
    n, size = len(y), len(word)
    inner = np.flatnonzero(~chains.new)  # tokens with a neighbour before them
    met = np.array([[((1 - y)[inner - 1] * (1 - y)[inner]).sum(), ((1 - y)[inner - 1] * y[inner]).sum()],
                    [(y[inner - 1] * (1 - y)[inner]).sum(), (y[inner - 1] * y[inner]).sum()]])
    bias = math.log((y.sum() + 1) / (n - y.sum() + 1))
    square, square_t, square_b = np.full(buckets, 1e-14), np.full((2, 2), 1e-14), 1e-14
    p = np.zeros(n)
    for step in range(STEPS + 1):
        sums = weights[word]
        odds = chains.potentials(sums[:, :-2].sum(axis=1) + bias, sums[:, -2], sums[:, -1])
        forward, backward = chains.ratios(odds, transition)
        both = forward * backward
        p = both / (1 + both)
        if step == STEPS:
            break
        rest = y - p
        at_own = np.bincount(chains.ids, weights=rest, minlength=size)
        at_before = np.bincount(chains.ids[inner - 1], weights=rest[inner], minlength=size)
        at_after = np.bincount(chains.ids[inner], weights=rest[inner - 1], minlength=size)
        gradient = np.zeros(buckets)
        for j in range(word.shape[1] - 2):
            gradient += np.bincount(word[:, j], weights=at_own, minlength=buckets)
        gradient += np.bincount(word[:, -2], weights=at_before, minlength=buckets)
        gradient += np.bincount(word[:, -1], weights=at_after, minlength=buckets)
        gradient = gradient / n - 1e-6 * weights
        gradient[-1] = 0.0
        e = np.exp(transition)
        f0, right = forward[inner - 1], odds[inner] * backward[inner]
        pair = np.array([[np.full(len(inner), e[0, 0]), e[0, 1] * right], [e[1, 0] * f0, e[1, 1] * f0 * right]])
        pair /= pair.sum(axis=(0, 1))
        step_t = (met - pair.sum(axis=2)) / n
        square += gradient**2
        weights += 0.5 * gradient / np.sqrt(square)
        square_t += step_t**2
        transition += 0.2 * step_t / np.sqrt(square_t)
        g = rest.mean()
        square_b += g * g
        bias += 0.5 * g / math.sqrt(square_b)
    x = scale_inputs(mass(p, chains.text, len(texts)), np.bincount(chains.text, minlength=len(texts)))
    scale = np.zeros(3)
    for _ in range(25):  # Newton steps of a logistic regression with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        scale += np.linalg.solve(h, x.T @ (label - q) - 0.1 * scale)
    kept = np.flatnonzero(np.abs(weights[:-1]) > 1e-3)
    return Model(names[kept], np.append(weights[kept], 0.0), bias, transition, tuple(scale))


def scale_inputs(total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log(total + 1e-4), np.log1p(tokens)], axis=1)


def measured(df: DataFrame, key: str, text: str, size: str | None = None) -> DataFrame:
    """``(h, size)`` per row: a hash of the key and the bytes of the text, read from ``size`` if named."""
    known = F.octet_length(text) if size is None else F.col(size)
    return df.select(F.xxhash64(key).alias("h"), F.coalesce(known, F.lit(0)).alias("size"))


def fit(
    labelled: DataFrame, key: str, text: str, label: str, rows: tuple[int, int] = SAMPLE_ROWS,
    sizes: tuple[int, int] = SAMPLE_BYTES, size: str | None = None,
) -> Model:
    """Fit to a bounded sample: at most ``rows`` rows labelled 1 and 0, the ones whose keys
    have the smallest hashes, without those that would bring their texts to more than ``sizes``
    bytes. Rows without a label or with another one do not count. With no toxic row every text
    scores near 0, with no other row 0.5. ``size`` names a column with the texts' bytes: where
    ``labelled`` is a join, it spares carrying all texts through it only to measure them."""
    texts: list[str] = []
    labels: list[int] = []
    for value, most, room in ((1, rows[0], sizes[0]), (0, rows[1], sizes[1])):
        own = labelled.filter(F.col(label) == value)
        # The ids are chosen first, so that texts are only carried for the rows that stay.
        ids = []
        for r in measured(own, key, text, size).orderBy("h", "size").limit(most).collect():
            if r.size <= room:
                room -= r.size
                ids.append(r.h)
        if not ids:
            continue
        picked = own.filter(F.xxhash64(key).isin(ids)).select(text).limit(most)
        for (t,) in picked.collect():
            texts.append(t or "")
            labels.append(value)
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    return learn([texts[i] for i in order], [labels[i] for i in order])


class Tagger:
    """Marginals of the tokens of texts; remembers the potentials of words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.tables = np.zeros((3, 0))

    def ids(self, tokens: list[str]) -> np.ndarray:
        new = {w for w in tokens if w not in self.known}
        if new and len(self.known) + len(new) > WORDS:
            self.known, self.tables = {}, np.zeros((3, 0))
            new = set(tokens)
        if new:
            for w in new:
                self.known[w] = len(self.known)
            w = self.model.weights[places(self.model.names, [features(w) for w in new])]
            added = np.stack([w[:, :-2].sum(axis=1) + self.model.bias, w[:, -2], w[:, -1]])
            self.tables = np.concatenate([self.tables, added], axis=1)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each text and its toxic spans: runs of tokens with a marginal of a half
        or more, with the largest one."""
        lists = [TOKEN.findall(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
        tokens = [w for x in lists for w in x]
        ids = self.ids(tokens)
        marks = [self.known.get(c, -1) for c in ENDS]
        chains = Chains(ids, np.isin(ids, marks), owner)
        odds = chains.potentials(*self.tables)
        forward, backward = chains.ratios(odds, self.model.transition)
        both = forward * backward
        p = both / (1 + both)
        counts = np.bincount(chains.text, minlength=len(texts))
        x = scale_inputs(mass(p, chains.text, len(texts)), counts)
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.scale), -60, 60)))
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        toxic = np.flatnonzero(p >= 0.5)
        places: dict[int, list[tuple[int, int]]] = {}
        last = -2
        for i in toxic:
            k = int(chains.text[i])
            if k not in places:
                places = {k: [m.span() for m in TOKEN.finditer(texts[k])]}
            a, b = places[k][chains.word[i] - first[k]]
            if i == last + 1 and not chains.new[i]:
                a0, _, s = spans[k][-1]
                spans[k][-1] = (a0, b, max(s, float(p[i])))
            else:
                spans[k].append((a, b, float(p[i])))
            last = i
        return score, spans


def score(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``(key, score, predicted, spans)`` per row; a null text is an empty one, and a text
    without tokens gets the score of one in which nothing is toxic. Row-local."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches, text):
            scores, spans = tagger.tag([t or "" for t in batch.column(1).to_pylist()])
            rows = [[{"start": a, "end": b, "score": s} for a, b, s in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()),
                 pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array(rows, kind)],
                names=[key, "score", "predicted", "spans"],
            )

    name = df.schema[key].dataType.simpleString()
    schema = f"{key} {name}, score double, predicted int, spans {SPANS}"
    return df.select(key, text).mapInArrow(run, schema)


def keep_clean(df: DataFrame, text: str, model: Model) -> DataFrame:
    """The rows of ``df``, with all their columns, that are not predicted toxic."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            scores, _ = tagger.tag([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < 0.5))

    return df.mapInArrow(run, df.schema)
