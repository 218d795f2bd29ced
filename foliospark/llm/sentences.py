"""Removal of sentence runs that were seen before, anywhere in the corpus.

A run has at least two sentences and a number of words. The shortest run that begins at each
sentence and the shortest that ends at each are hashed and joined over all texts; every run but
the first with its hash (smallest key, then earliest place) is removed with all its sentences.
Any longer run is covered by these: a sentence too near its end for a run of its own lies in
the one that ends with it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import slices, stored

LEAST_SENTENCES = 2
LEAST_WORDS = 15
#: Of each so many words in a row of a sentence, it is cut after the one with the least checksum.
#: What stands in two sentences is cut alike but for its first and last ``WINDOW - 1`` words, and
#: no gap is wider: any 50 words hold whole pieces with at least 50 - 4 * WINDOW + 2 = 16 of them.
WINDOW = 9

_LINE, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"\n", b".!?"))
#: A piece begins with this word.
_FIRST = np.uint64(0x5851F42D4C957F2D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: Bytes of text whose words are looked at together.
SLICE = 1_000_000


@dataclass
class Pieces:
    """The pieces of some texts, whose bytes stand in a row. Arrays of pieces have one entry
    more, for the end."""

    start: np.ndarray  # first byte of each piece; it goes on to the next one of its text
    words: np.ndarray  # words before each piece
    first: np.ndarray  # by text: its first piece (one more: the end)
    hashes: np.ndarray  # of each word, marked where a piece begins


def cut_pieces(raw: np.ndarray, starts: np.ndarray) -> Pieces:
    """Sentences, cut into pieces; each takes the white space behind it, so that together they
    are the whole text. Sentences end behind ``.!?`` and at line ends. One of any length is cut
    after words that depend on the words around them alone, so that a passage is cut alike
    wherever it stands in one. A text without words is one piece, an empty one has none."""
    begin, end = shingles.words(raw, starts)
    owner = np.searchsorted(starts, begin, side="right") - 1
    hashes = shingles.hashes_of(raw, begin, end)
    n = len(begin)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        lines = np.concatenate(([0], np.cumsum(_LINE[raw])))
        new[1:] = (
            (owner[1:] != owner[:-1]) | (lines[begin[1:]] > lines[end[:-1]]) | _STOP[raw[end[:-1] - 1]]
        )
    if n >= WINDOW:
        sentence = np.cumsum(new)
        inside = np.flatnonzero(sentence[: 1 - WINDOW] == sentence[WINDOW - 1:])
        best, place = hashes[inside], np.zeros(len(inside), np.int64)
        for i in range(1, WINDOW):
            other = hashes[inside + i]
            less = other < best
            best = np.where(less, other, best)
            place[less] = i
        after = inside + place + 1
        new[after[after < n]] = True
    head = np.flatnonzero(new)
    texts = len(starts) - 1
    # Texts without words but not empty are one piece as well.
    size = np.diff(starts)
    bare = np.flatnonzero((size > 0) & (np.bincount(owner, minlength=texts) == 0))
    of = np.concatenate((owner[head], bare))
    begins = np.concatenate((begin[head], starts[bare]))
    before = np.concatenate((head, np.searchsorted(begin, starts[bare])))
    order = np.lexsort((begins, of))
    of, begins, before = of[order], begins[order], before[order]
    first = np.searchsorted(of, np.arange(texts + 1))
    lead = first[:-1][first[:-1] < first[1:]]
    begins[lead] = starts[of[lead]]  # white space before the first word
    hashes = hashes.copy()
    hashes[head] ^= _FIRST
    return Pieces(np.append(begins, len(raw)), np.append(before, n), first, shingles.mix(hashes))


def runs(
    p: Pieces, least_sentences: int, least_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first, one past the last piece, counted in the text) of each shortest run
    that begins or ends at a piece."""
    n = len(p.start) - 1
    text = np.repeat(np.arange(len(p.first) - 1), np.diff(p.first))
    at = np.arange(n)
    stop, begin = p.first[1:][text], p.first[:-1][text]
    forward = np.maximum(at + least_sentences, np.searchsorted(p.words, p.words[:-1] + least_words))
    good = forward <= stop
    backward = np.minimum(
        at + 1 - least_sentences, np.searchsorted(p.words, p.words[1:] - least_words, side="right") - 1
    )
    # Pieces without words share a count of words; the run is the shortest one.
    back = backward >= begin
    first = np.concatenate((at[good], backward[back]))
    last = np.concatenate((forward[good], at[back] + 1))
    own = np.concatenate((text[good], text[back]))
    _, keep = np.unique(first * np.int64(n + 1) + last, return_index=True)
    first, last, own = first[keep], last[keep], own[keep]
    # The sum of hash * base ** place over a run, by differences of running sums.
    count = len(p.hashes)
    up, down = (np.full(count + 1, b) for b in (_BASE, _INVERSE))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(p.hashes * up[:-1], dtype=np.uint64)))
    a, b = p.words[first], p.words[last]
    value = shingles.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return own, value.view(np.int64), first - p.first[own], last - p.first[own]


def pieces(text: str) -> list[tuple[int, int]]:
    """The pieces of one text as (start, end), in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    p = cut_pieces(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ends = [len(raw[:i].decode("utf-8", "surrogatepass")) for i in p.start.tolist()]
    return list(zip(ends, ends[1:]))


def dedup(
    df: DataFrame, key: str, text: str,
    least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``(key, n_sentences, n_removed, text)`` per row: the text without the sentences of any
    run that came before, in a text with a smaller key or earlier in the same one.

    Null and empty texts have no sentences (and stay null or empty). Null keys come last, texts
    of one key in the order of a hash; equal rows count as one text and are all kept alike."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            raw, starts = shingles.utf8(batch.column(2))
            own, value, first, last = runs(cut_pieces(raw, starts), least_sentences, least_words)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(value),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["_row", "_key", "_hash", "_first", "_last"],
            )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            raw, starts = shingles.utf8(batch.column(1))
            p = cut_pieces(raw, starts)
            removed, kept = [], []
            old = batch.column(1)
            for i, gone in enumerate(batch.column(2).to_pylist()):
                if not gone:
                    removed.append(0)
                    kept.append(old[i].as_py())
                    continue
                lo, hi = p.first[i], p.first[i + 1]
                drop = np.zeros(hi - lo + 1, np.int64)
                for r in gone:
                    drop[r["_first"]] += 1
                    drop[r["_last"]] -= 1
                off = np.cumsum(drop)[:-1] > 0
                edge = np.append(p.start[lo:hi], starts[i + 1])
                kept.append(b"".join(raw[a:b].tobytes() for a, b in zip(edge[:-1][~off], edge[1:][~off])).decode())
                removed.append(int(off.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(p.first), pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())],
                names=[key, "n_sentences", "n_removed", "text"],
            )

    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.xxhash64(key, text).alias("_row"), F.col(key), F.col(text))
    places = stored(
        docs.mapInArrow(find, f"_row long, _key {kind}, _hash long, _first int, _last int"), "runs"
    )
    # Null keys come last. For whole numbers the largest one stands for them, which spares a flag
    # in every row that is shuffled; a text with that very key then ties with them.
    if isinstance(df.schema[key].dataType, T.IntegralType):
        place = [F.coalesce(F.col("_key").cast("long"), F.lit((1 << 63) - 1)).alias("_key")]
    else:
        place = [F.col("_key").isNull().alias("n"), F.col("_key")]
    order = F.struct(*place, "_row", "_first")
    # A hash that stands for a third of the rows is reduced before the shuffle, and meets the
    # rows in a join that can be split.
    first = stored(
        places.groupBy("_hash").agg(F.min(order).alias("_m"), F.count("*").alias("_n"))
        .filter("_n > 1").select("_hash", F.col("_m._row").alias("_r"), F.col("_m._first").alias("_f")),
        "first",
    )
    gone = (
        places.join(first, "_hash").filter("_row != _r or _first != _f")
        .groupBy("_row").agg(F.collect_set(F.struct("_first", "_last")).alias("_gone"))
    )
    return docs.join(gone, "_row", "left").select(key, text, "_gone").mapInArrow(
        cut, f"{key} {kind}, n_sentences long, n_removed long, text string"
    )
