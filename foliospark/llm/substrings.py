"""Removal of byte strings that stand in a text with a smaller key: suffix arrays over the
parts of the corpus that can repeat.

Every window of ``LENGTH`` bytes has an anchor, the K-byte string in it with the least hash
(the leftmost of equal ones). Equal windows have equal anchors at the same place, so windows
with one anchor form a segment, and windows of different anchors need not be compared.

1. Blocks of texts send the hashes of their anchors, each once and in six bytes; what comes
   from one text only is dropped.
2. Blocks send the segments of the anchors that are left, equal ones once, with the least and
   greatest key. A task gets all segments of an anchor and builds suffix arrays over them (see
   ``grouping``); suffixes that agree in ``LENGTH`` bytes lie side by side.
3. Blocks get back the least key of each window, and remove the bytes of every window whose
   key is smaller than their text's."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored
from .grouping import ranges, suffix_arrays
from .shingles import hashes_of, mix, powers, utf8

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1  # anchors that a window chooses from
#: Bytes of text in a block, and those that are looked at together.
BLOCK_BYTES, SLICE_BYTES = 4_000_000, 2_000_000
#: Bytes of text for each bin of anchors: about 9 MB of hashes.
BIN_BYTES = 24_000_000
#: Bytes of an anchor's segments above which they are cut into pieces of fewer windows (a
#: stretch before the anchor), and bytes that a task answers side by side.
LARGE, STRETCH, TOGETHER = 100, 4, 2_000_000
#: Stands for a null key: no key is greater.
LAST = np.iinfo(np.int64).max


def _read(raw: np.ndarray, n: int, at: int, kind: str) -> np.ndarray:
    """Little-endian numbers at raw[at], raw[at + 1] ... (n of them, overlapping)."""
    return np.ndarray((n,), kind, buffer=raw.tobytes(), offset=at, strides=(1,)).astype(np.uint64)


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(hash, text, first, last, anchor)`` of each segment: windows first to last (where they
    begin in ``raw``) of one text have their anchor at ``anchor``."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    n = len(raw) - K + 1
    windows = len(raw) - LENGTH + 1
    if windows <= 0:
        return none
    a, b = _read(raw, n, 0, "<u8"), _read(raw, n, 8, "<u8")
    c = _read(raw, n, 16, "<u4")
    h = mix(mix(a * np.uint64(0xD6E8FEB86659FD93) + b) * np.uint64(0xA0761D6478BD642F) + c)
    # The 40 upper bits decide, then the place: the least number is the leftmost least hash.
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    step, width = low, 1
    while 2 * width <= SPAN:
        step = np.minimum(step[: len(step) - width], step[width:])
        width *= 2
    low = np.minimum(step[:windows], step[SPAN - width : SPAN - width + windows])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(windows, bool)
    size = np.diff(starts)
    long = size >= LENGTH
    mark = np.zeros(windows + 1, np.int64)
    np.add.at(mark, starts[:-1][long], 1)
    np.add.at(mark, starts[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(mark[:windows]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    first, last = at[head], at[np.append(head[1:], len(at)) - 1]
    text = np.searchsorted(starts, first, side="right") - 1
    return h[anchor[first]], text, first, last, anchor[first]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_BYTES`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def _parts(texts: pa.Array):
    """Segments of all rows, a part at a time; a text that is larger than a part is looked at
    in pieces that overlap by a window less one byte, so that each window is in one piece."""
    for a, b in _pieces(texts):
        raw, starts = utf8(texts.slice(a, b - a))
        if len(raw) <= 4 * SLICE_BYTES:
            yield a, raw, 0, segments(raw, starts)
            continue
        for at in range(0, len(raw) - LENGTH + 1, SLICE_BYTES):  # one long text
            own = raw[at : at + SLICE_BYTES + LENGTH - 1]
            yield a, own, at, segments(own, np.array([0, len(own)]))


def _windows_of(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], np.int64)
    return np.frombuffer(b"".join(lists), np.uint8), np.concatenate(([0], np.cumsum(size)))


def _packed(keys: pa.Array, texts: pa.Array) -> bytes:
    """A block's rows as one compressed value: what is moved between tasks."""
    out = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([keys, texts], names=["key", "text"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue()


def _unpacked(block: bytes) -> tuple[pa.Array, pa.Array]:
    table = pa.ipc.open_stream(block).read_all().combine_chunks()
    if not table.num_rows:
        return pa.array([], table.schema.field(0).type), pa.array([], pa.string())
    return table["key"].combine_chunks(), table["text"].combine_chunks()


def _binary(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """raw[begin[i]:end[i]] of every i, as a binary column."""
    size = end - begin
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[at].tobytes())]
    ).cast(pa.binary())


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column in a row, and where each value begins (one more: the end)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def _substring_hashes(raw: np.ndarray):
    """A function from ``begin, end`` to hashes of ``raw[begin:end]``, each in a few steps."""
    powers_, down = powers(len(raw)), np.full(len(raw), pow(int(powers(2)[1]), -1, 1 << 64), np.uint64)
    down[:1] = 1
    value = raw.astype(np.uint64) + np.uint64(1)
    total = np.concatenate((
        np.zeros(1, np.uint64), np.cumsum(value * np.multiply.accumulate(down), dtype=np.uint64)
    ))
    return lambda begin, end: mix((total[end] - total[begin]) * powers_[end - 1] + (end - begin).astype(np.uint64))


def least_keys(
    raw: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray, heads: np.ndarray
) -> np.ndarray:
    """For each window of each piece ``raw[begin[i]:end[i]]``: the least key among the pieces of
    its group that hold it; ``heads`` says where groups begin. One suffix array for each group,
    all sorted side by side."""
    size = end - begin
    last = np.zeros(len(size), np.int64)
    last[np.append(heads[1:], len(size)) - 1] = 1
    # After a piece stands 1, after a group 0.
    ends = np.cumsum(size + 1 + last)
    start = ends - (size + 1 + last)
    total = int(ends[-1])
    flat = np.zeros(total, np.int64)
    flat[ranges(start, start + size)] = raw[ranges(begin, end)].astype(np.int64) + 2
    flat[start + size] = 1
    starts = np.append(start[heads], total)
    order = suffix_arrays(flat, starts)
    count = size - LENGTH + 1
    at = ranges(start, start + count)
    window = np.full(total, -1)
    window[at] = np.arange(len(at))
    text = np.repeat(np.arange(len(heads)), np.diff(starts))
    order = order[window[order] >= 0]
    # Neighbours in the order that agree in a whole window are one class.
    same = text[order[1:]] == text[order[:-1]]
    rows = np.flatnonzero(same)
    for i in range(LENGTH):
        rows = rows[flat[order[rows] + i] == flat[order[rows + 1] + i]]
    new = np.ones(len(order), bool)
    new[rows + 1] = False
    key = np.repeat(keys, count)[window[order]]
    head = np.flatnonzero(new)
    least = np.minimum.reduceat(key, head)
    found = np.empty(len(at), np.int64)
    found[window[order]] = np.repeat(least, np.diff(np.append(head, len(order))))
    return found


def _pieces_of(
    anchor: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, ...]:
    """``(segment, stretch, middle, first, windows)`` of the pieces that segments are cut into.

    Segments of an anchor with more than ``LARGE`` bytes are cut by windows: windows that begin
    in the same stretch before the anchor hold the same middle (``middle`` and the next
    ``LENGTH - STRETCH + 1`` bytes) if any of them are equal, and only those stay together. The
    others are one piece, with the stretch -1."""
    size = end - begin
    whole = np.bincount(anchor, weights=size)[anchor] <= LARGE
    count = size - LENGTH + 1
    far, near = at // STRETCH, (at - count + 1) // STRETCH  # of the first window, and the last one
    far, near = np.where(whole, -1, far), np.where(whole, -1, near)
    seg = np.repeat(np.arange(len(size)), far - near + 1)
    stretch = ranges(near, far + 1)
    inner = at[seg] - stretch * STRETCH  # where the last window of a whole stretch begins
    cut = stretch >= 0
    first = np.where(cut, np.maximum(inner - STRETCH + 1, 0), 0)
    last = np.where(cut, np.minimum(inner, count[seg] - 1), count[seg] - 1)
    return seg, stretch, begin[seg] + np.where(cut, inner, 0), first, last - first + 1


ANSWERS = ("block", "h", "seg", "least", "runs")


def _differing(
    h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, name: np.ndarray,
    raw: np.ndarray, begin: np.ndarray,
) -> pa.RecordBatch:
    """Answers for anchors with several segments, from rows ordered by (h, at, name)."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1]) | (name[1:] != name[:-1])
    head = np.flatnonzero(new)
    least, b, e = np.minimum.reduceat(low, head), begin[head], begin[head + 1]
    anchor = np.cumsum(np.concatenate(([True], h[head[1:]] != h[head[:-1]]))) - 1
    seg, stretch, middle, first, count = _pieces_of(anchor, at[head].astype(np.int64), b, e)
    hashes = _substring_hashes(raw)
    own = hashes(b[seg] + first, b[seg] + first + count + LENGTH - 1)
    inner = np.zeros(len(seg), np.uint64)
    cut = np.flatnonzero(stretch >= 0)
    inner[cut] = hashes(middle[cut], middle[cut] + LENGTH - STRETCH + 1)
    # Equal pieces of a group are one, with the smallest key.
    order = np.lexsort((own, inner, stretch, anchor[seg]))
    seg, first, count, own, inner, stretch = (x[order] for x in (seg, first, count, own, inner, stretch))
    other = np.ones(len(seg), bool)
    other[1:] = (inner[1:] != inner[:-1]) | (stretch[1:] != stretch[:-1]) | (anchor[seg[1:]] != anchor[seg[:-1]])
    differs = other.copy()
    differs[1:] |= own[1:] != own[:-1]
    piece = np.flatnonzero(differs)
    key = np.minimum.reduceat(least[seg], piece)
    group = np.cumsum(other[piece]) - 1
    # A piece that is alone in its group is equal to nothing but itself.
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    ends = np.cumsum(count[piece])
    value = np.repeat(key, count[piece])
    if len(some):
        p = piece[some]
        from_ = b[seg[p]] + first[p]
        heads = np.flatnonzero(np.concatenate(([True], group[some[1:]] != group[some[:-1]])))
        value[ranges(ends[some] - count[p], ends[some])] = least_keys(
            raw, from_, from_ + count[p] + LENGTH - 1, key[some], heads
        )
    of = np.cumsum(differs) - 1
    windows = e - b - LENGTH + 1
    edge = np.concatenate(([0], np.cumsum(windows)))
    found = np.empty(edge[-1], np.int64)
    to, source = edge[seg] + first, (ends - count[piece])[of]
    found[ranges(to, to + count)] = value[ranges(source, source + count)]
    least = np.minimum.reduceat(found, edge[:-1])
    # Runs of equal keys, of the segments that a block asks for.
    whose = np.cumsum(new) - 1
    rows = np.flatnonzero(high > least[whose])
    asked = np.unique(whose[rows])
    mark = np.ones(len(found), bool)
    mark[1:] = found[1:] != found[:-1]
    mark[edge[:-1]] = True
    start = np.flatnonzero(mark)
    length, at_ = np.diff(np.append(start, len(found))), np.searchsorted(start, edge)
    runs: list[bytes | None] = [None] * len(asked)
    for k in np.flatnonzero(at_[asked + 1] - at_[asked] > 1).tolist():
        i, j = at_[asked[k]], at_[asked[k] + 1]
        runs[k] = np.stack([length[i:j], found[start[i:j]]]).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(block[rows]), pa.array((h[rows] >> 32).astype(np.int32)), pa.array(name[rows]),
         pa.array(least[whose[rows]]),
         pa.array(runs, pa.binary()).take(pa.array(np.searchsorted(asked, whose[rows])))],
        names=list(ANSWERS),
    )


def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(h, at, name, seg, low, high, block)`` ordered by (h, at, name), to rows
    ``(block, h, seg, least, runs)``: for each block whose greatest key is above the least key
    of some window of the segment, that key, and where windows differ, their keys as runs of
    (windows, key). ``h`` is the upper half of the hash, ``seg`` the segment's name, a hash.

    Where all segments of an anchor are equal there is nothing to sort."""

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        h, at, name, low, high, block = (table[c].to_numpy() for c in ("h", "at", "name", "low", "high", "block"))
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        other = np.zeros(len(h), np.int64)
        other[1:] = (h[1:] == h[:-1]) & ((at[1:] != at[:-1]) | (name[1:] != name[:-1]))
        equal = np.add.reduceat(other, head) == 0
        size = np.diff(np.append(head, len(h)))
        least = np.repeat(np.minimum.reduceat(low, head), size)
        some = np.flatnonzero(np.repeat(equal, size) & (high > least))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[some]), pa.array((h[some] >> 32).astype(np.int32)), pa.array(name[some]),
             pa.array(least[some]), pa.nulls(len(some), pa.binary())],
            names=list(ANSWERS),
        )
        rest = np.flatnonzero(np.repeat(~equal, size))
        if not len(rest):
            return
        segs = table["seg"].combine_chunks().take(pa.array(rest))
        raw, begin = _bytes_of(segs)
        # Whole anchors of about TOGETHER bytes are sorted side by side.
        edge = np.flatnonzero(np.concatenate(([True], h[rest][1:] != h[rest][:-1])))
        part = np.searchsorted(np.arange(TOGETHER, begin[-1] + TOGETHER, TOGETHER), begin[edge], side="right")
        cuts = np.append(edge[np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))], len(rest))
        for a, b in zip(cuts[:-1], cuts[1:]):
            r = rest[a:b]
            yield _differing(
                h[r], at[r], low[r], high[r], block[r], name[r], raw[begin[a]: begin[b]], begin[a : b + 1] - begin[a]
            )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
        if cut or (held and held[-1]["h"][held[-1].num_rows - 1].as_py() != h[0]):
            if held or cut:
                yield from settled(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from settled(pa.Table.from_batches(held))


def dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per row: the text's UTF-8 bytes
    without every byte of a ``LENGTH``-byte string that also begins in a text with a smaller
    key. A null text is empty. Rows that share a key do not count against each other; null
    keys are greater than all others. Removal can cut a character in two, so ``kept`` is
    binary."""
    kind = df.schema[key].dataType.simpleString()

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            data = _packed(table.column(0).combine_chunks(), table.column(1).combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())],
                names=["block", "size", "rows"],
            )

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            start = 0
            for i, own in enumerate(sizes):
                if size and size + own > BLOCK_BYTES:
                    held.append(batch.slice(start, i - start))
                    yield block()
                    held, size, start, number = [], 0, i, number + 1
                size += own
            held.append(batch.slice(start))
        if sum(b.num_rows for b in held):
            yield block()

    docs = stored(
        df.select(key, F.coalesce(text, F.lit(""))).mapInArrow(label, "block long, size long, rows binary"), "blocks"
    )
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, -(-total // BIN_BYTES))

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        now = None

        def send():
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            hashes.clear()
            owners.clear()
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            same = h[1:] == h[:-1]
            head = np.flatnonzero(np.concatenate(([True], ~same)))
            many = np.zeros(len(h), np.int64)
            many[1:] = same & (owner[1:] != owner[:-1])
            many = np.add.reduceat(many, head) > 0
            h = h[head]
            of = (h % np.uint64(bins)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            h, many, of = h[order], many[order], of[order]
            cut = np.searchsorted(of, np.arange(bins + 1))
            some = np.flatnonzero(np.diff(cut))
            packed = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()), pa.array(np.full(len(some), now), pa.int64()),
                    pa.array([packed[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([np.packbits(many[cut[i] : cut[i + 1]]).tobytes() for i in some], pa.binary()),
                ],
                names=["bin", "block", "hashes", "many"],
            )

        for batch in batches:
            for now, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, texts = _unpacked(data.as_py())
                keys = _keys(keys)
                for row, _, _, (h, text_of, _, _, _) in _parts(texts):
                    if len(h):
                        hashes.append(h >> np.uint64(16))
                        owners.append(keys[row + text_of])
                if hashes:
                    yield send()

    def repeated(table: pa.Table) -> pa.Table:
        raw, starts = _windows_of(table.column("hashes").to_pylist())
        h = np.zeros((len(raw) // 6, 8), np.uint8)
        h[:, :6] = raw.reshape(-1, 6)
        h = h.view("<u8").ravel()
        sizes = np.diff(starts) // 6
        many = np.concatenate([
            np.unpackbits(np.frombuffer(m, np.uint8), count=c).astype(bool)
            for m, c in zip(table.column("many").to_pylist(), sizes.tolist())
        ])
        # A block is in two rows if two tasks read it; its hashes then count as repeated.
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        keep = (count > 1) | (np.bincount(inverse, weights=many) > 0)
        keep = keep[inverse]
        cut = np.concatenate(([0], np.cumsum(sizes)))
        packed = h.view(np.uint8).reshape(-1, 8)[:, :6]
        found = [packed[a:b][keep[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"block": table.column("block"), "hashes": pa.array(found, pa.binary())})

    def wanted(table: pa.Table) -> np.ndarray:
        raw, _ = _windows_of(table.column("hashes").to_pylist())
        h = np.zeros((len(raw) // 6, 8), np.uint8)
        h[:, :6] = raw.reshape(-1, 6)
        return np.unique(h.view("<u8").ravel())

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        """The segments of a block that may repeat; equal ones of a part of it once."""
        out = []
        for block, data in zip(left.column("block").to_pylist(), left.column("rows")) if right.num_rows else ():
            want = wanted(right)
            keys, texts = _unpacked(data.as_py())
            keys = _keys(keys)
            for row, raw, _, (h, text_of, first, last, anchor) in _parts(texts):
                some = np.flatnonzero(np.isin(h >> np.uint64(16), want))
                if not len(some):
                    continue
                hh, first, end = h[some].view(np.int64), first[some], last[some] + LENGTH
                at, key = (anchor[some] - first), keys[row + text_of[some]]
                name = hashes_of(raw, first, end).view(np.int64)
                order = np.lexsort((name, at, hh))
                a, b, c = hh[order], at[order], name[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
                head = np.flatnonzero(new)
                one = order[head]
                out.append(pa.table({
                    "h": hh[one], "at": at[one].astype(np.int32), "name": name[one],
                    "seg": _binary(raw, first[one], end[one]),
                    "low": np.minimum.reduceat(key[order], head), "high": np.maximum.reduceat(key[order], head),
                    "block": np.full(len(one), block),
                }))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("h", "at", "name", "seg", "low", "high", "block")
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        done = [
            pa.table({"key": keys, **{n: pa.array(c, t) for n, t, c in zip(names, kinds, rest)}})
            for keys, *rest in (cut(_unpacked(data.as_py()), right) for data in left.column("rows"))
        ]
        return pa.concat_tables(done) if done else pa.table({"key": pa.array([], key_type), **{n: pa.array([], t) for n, t in zip(names, kinds)}})

    def cut(block: tuple[pa.Array, pa.Array], right: pa.Table) -> tuple:
        own, texts = block
        keys = _keys(own)
        names, place = np.unique(right.column("seg").to_numpy(), return_index=True)
        least_of = right.column("least").to_numpy()
        runs_of = right.column("runs").combine_chunks()
        hashes = np.unique(right.column("h").to_numpy())
        whole, begin = utf8(texts)
        mark = np.zeros(len(whole) + 1, np.int32)
        for row, raw, shift, (h, text_of, first, last, _) in _parts(texts) if len(names) else ():
            some = np.flatnonzero(np.isin((h.view(np.int64) >> 32).astype(np.int32), hashes))
            first, last, key = first[some], last[some], keys[row + text_of[some]]
            name = hashes_of(raw, first, last + LENGTH).view(np.int64)
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            answer = place[at]
            hit = np.flatnonzero((names[at] == name) & (least_of[answer] < key))
            base = int(begin[row]) + shift
            whole_ = np.flatnonzero(runs_of.take(pa.array(answer[hit])).is_null().to_numpy(zero_copy_only=False))
            plain = hit[whole_]
            np.add.at(mark, base + first[plain], 1)
            np.add.at(mark, base + last[plain] + LENGTH, -1)
            for i in np.delete(hit, whole_).tolist():
                count, least = np.frombuffer(runs_of[int(answer[i])].as_py(), np.int64).reshape(2, -1)
                starts = base + first[i] + np.cumsum(count) - count
                less = least < key[i]
                np.add.at(mark, starts[less], 1)
                np.add.at(mark, (starts + count - 1 + LENGTH)[less], -1)
        gone = np.cumsum(mark[:-1]) > 0
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            off = gone[a:b]
            kept = whole[a:b][~off].tobytes()
            spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
            for column, value in zip(rows, (b - a, int(off.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        return own, *rows

    key_type = to_arrow_type(df.schema[key].dataType)
    by_block = docs.select("block", "rows").groupBy("block")
    sent = docs.select("block", "rows").mapInArrow(
        anchors, "bin long, block long, hashes binary, many binary"
    )
    back = stored(
        sent.groupBy("bin").applyInArrow(repeated, "block long, hashes binary"), "repeated"
    )
    found = by_block.cogroup(back.groupBy("block")).applyInArrow(
        collect, "h long, at int, name long, seg binary, low long, high long, block long"
    )
    ordered = found.repartition("h").sortWithinPartitions("h", "at", "name")
    least = stored(
        ordered.mapInArrow(classes, "block long, h int, seg long, least long, runs binary"), "classes"
    )
    result = by_block.cogroup(least.groupBy("block")).applyInArrow(
        remove,
        f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
    return result.withColumnRenamed("key", key)
