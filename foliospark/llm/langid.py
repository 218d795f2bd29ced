"""Language identification by hyperdimensional profiles.

Every letter of a small alphabet has a random vector of +1 and -1. A trigram binds its three
letters, each permuted by its place, with an element-wise product. A text is the bundle (the
sum) of its trigrams, a language the bundle of its texts, and a text gets the language whose
prototype has the largest cosine with it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LETTERS = 64
DIMENSION = 1024
SEED = 20_240_501
#: Code points below this are looked up; above it there are no letters.
CODE_POINTS = 0x32400
#: Texts that are compared in one matrix product.
BLOCK = 256


def alphabet() -> np.ndarray:
    """Code point -> letter number; 0: not a letter. a to z in either case have numbers of
    their own, other letters share the rest, neighbours in Unicode not with each other."""
    table = np.zeros(CODE_POINTS, np.uint8)
    for i in range(CODE_POINTS):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[i] = low - 96 if 97 <= low <= 122 else 27 + low % (LETTERS - 27)
    return table


def letter_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2, (LETTERS, DIMENSION), dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A row for each trigram code: the letters' vectors, shifted by place and multiplied."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    bound = first[codes >> 12] * second[codes >> 6 & 63] * letters[codes & 63]
    return bound.astype(np.float32)


def trigrams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts and the text that each belongs to. Everything between two
    words counts as one gap; the middle of a trigram is a letter, so it stays in its word."""
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = table[np.minimum(points, CODE_POINTS - 1)]
    letter[points >= CODE_POINTS] = 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    keep = np.flatnonzero((letter != 0) | np.concatenate(([False], letter[:-1] != 0)))
    letter, owner = letter[keep].astype(np.int32), owner[keep]
    before = np.concatenate(([0], letter[:-1]))
    after = np.concatenate((letter[1:], [0]))
    middle = np.flatnonzero(letter)
    codes = before[middle] << 12 | letter[middle] << 6 | after[middle]
    return codes, owner[middle]


def bundle(texts: list[str], table: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """One row per text: the sum of its trigram vectors (all zero without letters)."""
    codes, owner = trigrams(texts, table)
    seen = np.zeros(LETTERS**3, bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    if not len(distinct):
        return np.zeros((len(texts), DIMENSION), np.float32)
    place = np.zeros(LETTERS**3, np.int32)
    place[distinct] = np.arange(len(distinct))
    counts = np.bincount(
        owner.astype(np.int64) * len(distinct) + place[codes], minlength=len(texts) * len(distinct)
    )
    counts = counts.reshape(len(texts), len(distinct)).astype(np.float32)
    return counts @ trigram_vectors(distinct, letters)


def fit(labelled: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from all rows with a label.

    Tasks count trigrams for each language, Spark adds the counts, and tasks bundle the sums.
    What reaches the driver is one vector of ``DIMENSION`` numbers for each language and
    partition of a table that has at most ``LETTERS ** 3`` rows for each language. Without
    labelled rows there are no languages. Prototypes are compared after the mean of all
    languages, which is what they share, has been taken away."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = alphabet()
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, text):
            names = batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for name in set(names):
                codes, _ = trigrams([t for t, n in zip(texts, names) if n == name], table)
                own = sums.setdefault(name, np.zeros(LETTERS**3, np.int64))
                own += np.bincount(codes, minlength=LETTERS**3)
        for name, own in sums.items():
            codes = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int32()),
                 pa.array(own[codes], pa.int64())],
                names=["name", "code", "n"],
            )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            codes, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in set(names):
                own = np.flatnonzero(names == name)
                for part in np.array_split(own, len(own) // 4096 + 1):
                    vectors = trigram_vectors(codes[part], letters)
                    sums[name] = sums.get(name, 0) + n[part].astype(np.float64) @ vectors
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))],
            names=["name", "vector"],
        )

    rows = (
        labelled.filter(F.col(lang).isNotNull())
        .select(F.col(text), F.col(lang).alias("_lang"))
        .mapInArrow(count, "name string, code int, n long")
        .groupBy("name", "code").agg(F.sum("n").alias("n"))
        .mapInArrow(add, "name string, vector array<double>")
    )
    parts: dict[str, np.ndarray] = {}
    for name, vector in rows.collect():
        parts[name] = parts.get(name, 0) + np.array(vector)
    names = sorted(parts)
    found = np.array([parts[n] / max(np.linalg.norm(parts[n]), 1e-9) for n in names])
    if len(names) > 1:
        found = found - found.mean(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return names, found.astype(np.float32).reshape(len(names), DIMENSION)


def predict(
    df: DataFrame, key: str, text: str, model: tuple[list[str], np.ndarray]
) -> DataFrame:
    """``(key, lang_pred, score)`` per row; score is (1 + cosine) / 2.

    A null text, one without a letter, and any text where the model knows no language give
    ``und`` with score 0. Equal cosines give the first language by name. Row-local."""
    names, prototypes = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, letters = alphabet(), letter_vectors()
        for piece in slices(batches, text):
            for at in range(0, piece.num_rows, BLOCK):
                batch = piece.slice(at, BLOCK)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                own = bundle(texts, table, letters)
                size = np.linalg.norm(own, axis=1)
                # Trigrams can cancel out; only a text without letters has none at all.
                some = np.array([bool(names) and any(map(str.isalpha, t)) for t in texts])
                if names:
                    cosine = own @ prototypes.T / np.maximum(size, 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    top = np.clip((1 + cosine.max(axis=1)) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([names[best[i]] if s else "und" for i, s in enumerate(some)], pa.string()),
                        pa.array([float(top[i]) if s else 0.0 for i, s in enumerate(some)], pa.float64()),
                    ],
                    names=[key, "lang_pred", "score"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")
