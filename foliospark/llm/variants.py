"""Spelling variants: words that are one edit from each other, found in bit-sliced indexes.

A word belongs to a few groups, by one half of its letters; two words that differ by one edit
share such a half. In a group the vocabulary is a bitset for each (position, letter), and words
are read letter by letter against all of it at once: one set holds the words that agree so far,
three more those that agree but for one replaced, inserted or deleted letter, whose positions
are shifted against the reader's by none, one ahead and one behind."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Runs of letters: ASCII and the Latin-1 block.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose bitsets a task holds, and words that are read against them together.
BLOCK_WORDS, READ_WORDS = 16_384, 256


def vocabulary(
    df: DataFrame, key: str, text: str, every: int = 97, length: int = 5, least: int = 3
) -> DataFrame:
    """``(word, n)``: words of at least ``length`` code points that occur ``least`` times.

    Words are runs of letters, A-Z in lower case. Where ``every`` divides the checksum of
    ``<key>:<run>``, the run loses one letter, chosen by the checksum. A null key counts as
    empty text, a null text has no words."""
    runs = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("_run"),
    )
    mark = F.crc32(F.concat("_key", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_mark") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(F.col("_mark") % every == 0, cut).otherwise(F.col("_run"))
    return (
        runs.select("_run", mark.alias("_mark")).select(word.alias("word"))
        .filter(F.length("word") >= length)
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    )


def halves(word: Column) -> Column:
    """The groups of a word: (length class, side, half) for the class of its own length and of
    one less, as in a pair the shorter word's length tells where the halves part."""
    size = F.length(word)
    out = []
    for less in (0, 1):
        half = F.floor((size - less) / 2).cast("int")
        rest = size - less - half
        out += [
            F.struct((size - less).alias("size"), F.lit(0).alias("side"), F.substring(word, F.lit(1), half).alias("half")),
            F.struct((size - less).alias("size"), F.lit(1).alias("side"), F.substring(word, size - rest + 1, rest).alias("half")),
        ]
    return F.array(*out)


class Index:
    """Bitsets over a few words: who has a letter at a position, and who has a length."""

    def __init__(self, words: list[str]):
        self.words = words
        n = len(words)
        self.size = np.array([len(w) for w in words])
        self.longest = int(self.size.max(initial=0))
        codes = np.zeros((n, self.longest), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(n), self.size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        codes[row, column] = flat
        self.letters = np.unique(flat)
        self.blank = len(self.letters)  # a letter that no word has
        self.bits = np.zeros((self.longest + 1, self.blank + 1, -(-n // 64)), np.uint64)
        self._set(self.bits, column, np.searchsorted(self.letters, flat), row)
        self.of_size = np.zeros((self.longest + 3, 1, self.bits.shape[2]), np.uint64)
        self._set(self.of_size, self.size, np.zeros(n, np.int64), np.arange(n))
        #: Words longer than a position.
        self.beyond = np.bitwise_or.reduce(self.bits, axis=1)

    @staticmethod
    def _set(bits: np.ndarray, i: np.ndarray, j: np.ndarray, word: np.ndarray) -> None:
        place = (i * bits.shape[1] + j) * bits.shape[2] + word // 64
        np.bitwise_or.at(bits.reshape(-1), place, np.uint64(1) << (word % 64).astype(np.uint64))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): word i of ``words``, all of one length, is one edit from own word j."""
        n, width = len(words), len(words[0])
        if width > self.longest + 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, width)
        code = np.searchsorted(self.letters, flat)
        known = self.letters[np.minimum(code, self.blank - 1)] == flat
        code = np.where(known, code, self.blank)
        same = np.full((n, self.bits.shape[2]), ~np.uint64(0))
        other, longer, shorter = (np.zeros_like(same) for _ in range(3))
        last = self.longest
        for i in range(width):
            here = self.bits[min(i, last), code[:, i]]  # position ``longest`` holds nobody
            ahead = self.bits[min(i + 1, last), code[:, i]]
            behind = self.bits[i - 1, code[:, i]] if i else np.uint64(0)
            longer = (longer | same) & ahead
            shorter = (shorter & behind) | same
            other = (other & here) | (same & ~here & self.beyond[min(i, last)])
            same = same & here
        # One letter more at the end of a word that agrees to there.
        longer |= same
        found = (
            (other & self.of_size[min(width, last + 2)]) | (longer & self.of_size[min(width + 1, last + 2)])
            | (shorter & self.of_size[width - 1])
        )
        row, place = np.nonzero(found)
        bits = np.unpackbits(found[row, place][:, None].view(np.uint8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return row[at], place[at] * 64 + bit


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: each pair of words (columns word, n) that differ by exactly
    one inserted, deleted or replaced code point, both ways round.

    A pair comes out in the group of the first half, or of the last where the first differs.
    Groups are split: a task holds the bitsets of some words and reads all words of the group
    against them."""
    words = words.select("word", "n")
    grouped = words.select(F.explode(halves(F.col("word"))).alias("g"), "word", "n").select("g.*", "word", "n")
    sizes = grouped.groupBy("size", "side", "half").agg(F.count("*").alias("_count")).filter("_count > 1")
    blocks = F.ceil(F.col("_count") / BLOCK_WORDS).cast("int")
    met = grouped.join(sizes.withColumn("_blocks", blocks).drop("_count"), ["size", "side", "half"])
    own = F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int")
    # Every word is read in every block of its group, and held in its own one.
    dealt = met.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keys = ["size", "side", "half", "_block"]
    dealt = dealt.select(*keys, (F.col("_own") == F.col("_block")).alias("_held"), "word", "n")
    # Few bytes, much work: a given number of partitions is not merged by size.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("_held"), "word")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, None
        held: list[tuple[str, int]] = []
        counts = np.zeros(0, np.int64)
        out: list[list] = [[], [], [], []]

        def read(some: list[tuple[str, int]], side: int, size: int) -> None:
            for width in (size, size + 1):
                part = [w for w in some if len(w[0]) == width]
                for start in range(0, len(part), READ_WORDS):
                    batch = part[start: start + READ_WORDS]
                    for i, j in zip(*(x.tolist() for x in index.near([w for w, _ in batch]))):
                        word, other = batch[i][0], index.words[j]
                        # The class of a pair is the shorter length; its first half comes first.
                        if min(len(word), len(other)) != size:
                            continue
                        if side and word[: size // 2] == other[: size // 2]:
                            continue
                        for column, value in zip(out, (word, batch[i][1], other, int(counts[j]))):
                            column.append(value)

        def build() -> None:
            nonlocal index, counts
            index = Index([w for w, _ in held])
            counts = np.array([n for _, n in held], np.int64)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                names=["word", "n", "near", "near_n"],
            )
            for column in out:
                column.clear()
            return made

        for batch in batches:
            columns = [batch[c].to_pylist() for c in [*keys, "_held", "word", "n"]]
            rows = list(zip(*columns))
            start = 0
            while start < len(rows):
                now = rows[start][:4]
                end = start
                while end < len(rows) and rows[end][:4] == now:
                    end += 1
                if now != key:
                    if index is None and held:  # the group before had held words only
                        build()
                        read(held, key[1], key[0])
                    key, index, held = now, None, []
                some = [(r[5], r[6]) for r in rows[start:end]]
                mine = [w for w, r in zip(some, rows[start:end]) if r[4]]
                held += mine
                if len(mine) < len(some):
                    if index is None and held:
                        build()
                        read(held, key[1], key[0])
                    if index is not None:
                        read(some[len(mine):], key[1], key[0])
                start = end
                if len(out[0]) > 10_000:
                    yield flush()
        if index is None and held:
            build()
            read(held, key[1], key[0])
        yield flush()

    return ordered.mapInArrow(run, "word string, n long, near string, near_n long")


def forms(words: DataFrame, times: int = 2) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of ``words`` (word, n; words are
    unique). The form is the near word that occurs most, ties to the first in code-point order,
    if it occurs ``times`` as often; the root is where the forms lead, the word itself if
    nowhere. ``times`` is above 1, so that forms never lead in a circle."""
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= F.col("n") * times, F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= F.col("n") * times, -F.col("best.less")).alias("form_n"),
    )
    known = stored(known, "forms")
    # A form occurs at least twice as often, so ways are short; each round doubles the step.
    step = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = step.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        step = stored(step, "roots")
        if step.filter("_moved").isEmpty():
            break
        step = step.drop("_moved")
    return known.join(step.select("word", "root"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
