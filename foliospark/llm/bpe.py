"""Byte-level BPE: encoding with the tokenizers library, decoding by the byte table."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Pieces whose ids a worker remembers; beyond it the memory is emptied.
PIECES = 300_000
#: Bytes of text whose pieces are split and merged together; a longer text is read in parts.
SLICE = 500_000
#: Pieces of a long text that are held at a time.
PART_PIECES = 20_000
#: Longest piece that is remembered, in characters.
PIECE_CHARS = 64

DIGEST = "{id} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = (
    "{id} {kind}, ids array<int>, byte_starts array<int>, char_starts array<int>"
)


def byte_table() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable bytes stand for themselves, the
    others are numbered upwards from 256 in byte order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if chr(b) not in table]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A byte-level vocabulary: text to ids piece by piece, ids back to bytes."""

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.pattern = regex.compile(pattern)
        with open(vocabulary, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        table = byte_table()
        size = max(entries.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in entries.items():
            # An entry outside the table is a special token, which ordinary text never gives.
            if all(c in table for c in token):
                self.bytes[i] = bytes(table[c] for c in token)
        self.names = [str(i) for i in range(size)]
        self.known: dict[str, tuple[int, ...]] = {}

    def _merge(self, parts: list[list[str]]) -> Iterator[list[int]]:
        """Ids of each list of pieces; pieces met before are not merged again."""
        new = list({p for own in parts for p in own if p not in self.known})
        if len(self.known) + len(new) > PIECES:
            self.known = {}
            new = list({p for own in parts for p in own})
        if new:
            coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.known.update((p, tuple(c.ids)) for p, c in zip(new, coded))
            del coded
        get = self.known.__getitem__
        for own in parts:
            yield list(chain.from_iterable(map(get, own)))
        for p in new:
            if len(p) > PIECE_CHARS:
                del self.known[p]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. Every match of the pattern is merged on its own."""
        if len(texts) > 1 or len(texts[0]) <= SLICE:
            yield from self._merge([self.pattern.findall(t) for t in texts])
            return
        out: list[int] = []
        pieces = (m[0] for m in self.pattern.finditer(texts[0]))
        while part := list(islice(pieces, PART_PIECES)):
            for ids in self._merge([part]):
                out += ids
        yield out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids. A character may be split over several ids, so only the whole
        is text again."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that end in the middle of a character are replaced."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def starts(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Where each token begins, in bytes and in code points. A token that begins inside
        a character is given that character's place."""
        spans = [self.bytes[i] for i in ids]
        at = [0, *accumulate(map(len, spans))][: len(ids)]
        lead = [sum(b & 0xC0 != 0x80 for b in s) for s in spans]
        seen = [0, *accumulate(lead)][: len(ids)]
        return at, [
            n - 1 if s and s[0] & 0xC0 == 0x80 else n for n, s in zip(seen, spans)
        ]


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encode(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``(key, ids, byte_starts, char_starts)`` per row; a null text is an empty one.

    Row-local, no shuffle. Repeated rows give repeated results, other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        for batch in slices(batches, text, SLICE):
            ids = list(codec.encode(texts_of(batch, text)))
            starts = [codec.starts(i) for i in ids]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, ints),
                    pa.array([s[0] for s in starts], ints),
                    pa.array([s[1] for s in starts], ints),
                ],
                names=[key, "ids", "byte_starts", "char_starts"],
            )

    schema = ENCODED.format(id=key, kind=_kind(df, key))
    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str, pattern: str) -> DataFrame:
    """``(key, text)`` from token ids; a null list is an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        for batch in batches:
            out = [codec.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string())], names=[key, "text"]
            )

    return df.select(key, ids).mapInArrow(run, f"{key} {_kind(df, key)}, text string")


def roundtrip(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: encodes, then decodes the ids, and
    keeps only digests, so that ids never leave the task. A null text is an empty one; repeated
    rows give repeated results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        sha = hashlib.sha256
        for batch in slices(batches, text, SLICE):
            count, digest, back = [], [], []
            for ids in codec.encode(texts_of(batch, text)):
                count.append(len(ids))
                shown = " ".join(map(codec.names.__getitem__, ids))
                digest.append(sha(shown.encode()).hexdigest())
                back.append(sha(codec.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(back, pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = DIGEST.format(id=key, kind=_kind(df, key))
    return df.select(key, text).mapInArrow(run, schema)


def tokens(df: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``(key, n_tokens, ids, exact)``: the ids, and whether they decode to the text's bytes.
    A null text is an empty one; repeated rows give repeated results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        for batch in slices(batches, text, SLICE):
            ids, exact = [], []
            texts = texts_of(batch, text)
            for own, source in zip(codec.encode(texts), texts):
                exact.append(codec.decode_bytes(own) == source.encode())
                ids.append(np.array(own, np.int32))
            size = np.array([len(i) for i in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))),
                 pa.array(exact, pa.bool_())],
                names=[key, "n_tokens", "ids", "exact"],
            )

    schema = f"{key} {_kind(df, key)}, n_tokens long, ids array<int>, exact boolean"
    return df.select(key, text).mapInArrow(run, schema)
