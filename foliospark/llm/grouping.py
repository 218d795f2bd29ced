"""Suffix arrays by grouping, for many small texts side by side.

Phase one starts with the suffixes grouped by their first symbol and takes the groups from the
highest down. When a group is taken, its common prefix is the longest Lyndon prefix of its
suffixes; the last suffix before each of them that is in a lower group has this prefix behind
its own, and leaves its group for a new one right above. In the end the groups are the Lyndon
prefixes in order. Phase two goes up the order: the suffixes whose Lyndon prefix ends where the
suffix just met begins are the next of their groups; they are found along the pointers to the
previous smaller suffix. Nothing is renamed or solved recursively. A step is taken in all
texts at once, each operation being one over arrays."""

from __future__ import annotations

import numpy as np


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1 and so on."""
    size = last - first
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, ordered within each text.

    Text t takes symbols[starts[t] : starts[t + 1]]; it ends with 0 and holds no other 0."""
    n, texts = len(symbols), len(starts) - 1
    begin, end = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    owner = np.repeat(np.arange(texts), end - begin)
    order = np.lexsort((symbols, owner))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    heads = np.flatnonzero(new)
    group = np.empty(n, np.int64)  # of each suffix: where its group begins in the order
    group[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    close = np.zeros(n, np.int64)  # where the group that begins here ends
    close[heads] = np.append(heads[1:], n)
    before = np.arange(n) - 1  # the last suffix before that is in a lower group
    before[begin] = -1
    marked = np.zeros(n, bool)
    top = end.copy()  # of each text: the end of what is not taken yet
    live = np.flatnonzero(top > begin)
    while len(live):
        low = group[order[top[live] - 1]]
        members = order[ranges(low, top[live])]
        rank = group[members]
        to = before[members]
        while True:
            again = (to >= 0) & (group[to] >= rank)
            if not again.any():
                break
            to[again] = before[to[again]]
            before[members] = to
        before[members] = to
        met, times = np.unique(to[to >= 0], return_counts=True)
        round_ = 1
        while len(met):
            _split(met, order, place, group, close, marked)
            round_ += 1
            keep = times >= round_
            met, times = met[keep], times[keep]
        top[live] = low
        live = live[low > begin[live]]
    return _emit(begin, end, order, group, before)


def _split(
    some: np.ndarray, order: np.ndarray, place: np.ndarray, group: np.ndarray,
    close: np.ndarray, marked: np.ndarray,
) -> None:
    """Move ``some`` suffixes out of their groups into new ones right above them."""
    some = some[np.argsort(group[some], kind="stable")]
    old = group[some]
    first = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
    size = np.diff(np.append(first, len(some)))
    heads = old[first]
    tails = close[heads]
    cut = tails - size
    part = cut > heads  # else the whole group goes, which changes nothing
    if not part.any():
        return
    moved = np.repeat(part, size)
    some, heads, tails, cut, size = some[moved], heads[part], tails[part], cut[part], size[part]
    marked[some] = True
    slots = ranges(cut, tails)
    out = slots[~marked[order[slots]]]
    at = place[some]
    into = at[at < np.repeat(cut, size)]
    a, b = order[into], order[out]
    order[into], order[out] = b, a
    place[b], place[a] = into, out
    group[some] = np.repeat(cut, size)
    close[cut], close[heads] = tails, cut
    marked[some] = False


def _emit(
    begin: np.ndarray, end: np.ndarray, order: np.ndarray, group: np.ndarray, before: np.ndarray
) -> np.ndarray:
    out = order.copy()
    free = np.arange(len(order))  # the next free place of the group that begins here
    done = np.zeros(len(order), bool)
    done[end - 1] = True  # the final 0 is the first of its text already
    longest = int((end - begin).max(initial=0))
    by_length = np.argsort(begin - end, kind="stable")
    begin, length = begin[by_length], (end - begin)[by_length]
    active = np.searchsorted(-length, -np.arange(longest), side="left")
    for i in range(longest):
        first = begin[: active[i]]
        now = out[first + i] - 1
        now = now[now >= first]
        while True:
            now = now[now >= 0]
            now = now[~done[now]]
            if not len(now):
                break
            slot = free[group[now]]
            out[slot] = now
            free[group[now]] += 1
            done[now] = True
            now = before[now]
    return out
