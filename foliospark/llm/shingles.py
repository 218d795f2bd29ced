"""Word shingles of texts as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more: the end); null: empty."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    """1, b, b ** 2 ... modulo 2 ** 64."""
    out = np.full(n, _BASE)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; words are cut at white space and at the ends of texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:n]
    begin = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    return begin, np.flatnonzero(inside & ~after) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased) and the text it is in."""
    begin, end = words(raw, starts)
    return hashes_of(raw, begin, end, _LOWER), np.searchsorted(starts, begin, side="right") - 1


def hashes_of(
    raw: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray | None = None
) -> np.ndarray:
    """A hash of the bytes of each word, the same wherever it stands; ``table`` maps bytes to
    what they count as."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    n = len(raw)
    length = end - begin
    # The sum of byte * b ** place over a word, by differences of running sums; places count
    # from the end of the word, so that they do not depend on where the word is.
    out = np.zeros(len(begin), np.uint64)
    table = np.arange(256, dtype=np.uint64) if table is None else table
    value = (table + np.uint64(1))[raw]
    longest = int(length.max(initial=0))
    if longest <= 64:
        at = begin.copy()
        for i in range(longest):
            live = length > i
            if not live.all():
                rows = np.flatnonzero(live)
                out[rows] = out[rows] * _BASE + value[at[rows] + i]
            else:
                out = out * _BASE + value[at + i]
    else:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        # S[i] = sum over j < i of value[j] * inverse ** j; a word is (S[e] - S[b]) * base ** (e-1)
        steps = np.full(n, inverse)
        steps[0] = 1
        down = np.multiply.accumulate(steps)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * down, dtype=np.uint64)))
        out = (total[end] - total[begin]) * powers(n)[end - 1]
    return mix(out + length.astype(np.uint64))


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within a text, and where each text's begin
    (one more: the end). A text of fewer words than a shingle is one shingle, one without
    words has none."""
    raw, starts = utf8(column)
    texts = len(starts) - 1
    word, owner = word_hashes(raw, starts)
    count = np.bincount(owner, minlength=texts)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    n = len(word)
    h = np.zeros(max(n - WIDTH + 1, 0), np.uint64)
    for i in range(WIDTH):
        h += word[i : len(h) + i] * _ODD[i]
    whole = owner[: len(h)] == owner[WIDTH - 1 :] if len(h) else np.zeros(0, bool)
    h, own = mix(h[whole]), owner[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        extra = count[short].astype(np.uint64)
        for i in range(WIDTH - 1):
            live = count[short] > i
            extra[live] += word[first[short[live]] + i] * _ODD[i]
        h, own = np.concatenate((h, mix(extra))), np.concatenate((own, short))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=texts)))).astype(np.int64)
