"""Terminology table: additive merge, search, and matching terms against texts."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from .staging import durable

TERM_COLUMNS = ("english", "vietnamese", "category", "note")
# A gram that this share of a sample of texts holds is dealt to this many tasks.
HOT_SHARE, HOT_PARTS, HOT_SAMPLE = 0.01, 64, 5_000
# Fewer texts than this make no key too large for a task.
HOT_TEXTS = 1_000_000

# Needles up to this length are looked up by their first characters (all of two, three of
# longer ones) at every position of a text, which shows as many characters there.
EXACT_LENGTH, HEAD = 6, 3
# Terms (about 200 bytes each in a Python worker) that are sent to every task, counted first; with
# more of them texts and terms are shuffled.
BROADCAST_TERMS = 100_000
# Words of texts, of at most so many characters, whose terms a task remembers.
MEMO_WORDS, MEMO_LENGTH = 200_000, 32
# Texts of a batch that are turned into Python strings at a time.
TEXTS_AT_ONCE = 256
# Anchors (about 60 bytes each) that are sent to every task, counted first; more are shuffled.
BROADCAST_ANCHORS = 500_000
# Longer ones: (shortest length, gram length q). A text cut into consecutive grams of
# length q holds one whole gram of every occurrence of a needle of 2q - 1 characters
# or more, whichever of the needle's q phases it falls on.
LONG_CLASSES = ((7, 4), (15, 8))


def term_key(english: Column) -> Column:
    return F.lower(X.trim_low(english))


def clean_terms(terms: DataFrame) -> DataFrame:
    """Trimmed rows with both sides present, header row dropped."""
    en, vi = X.trim_low(F.col("english")), X.trim_low(F.col("vietnamese"))
    tidy = {
        "english": en,
        "vietnamese": F.replace(vi, F.lit("\\n"), F.lit("\n")),
        "category": X.trim_low(F.coalesce("category", F.lit(""))),
        "note": X.trim_low(F.coalesce("note", F.lit(""))),
    }
    kept = terms.filter((en != "") & (vi != "") & (F.lower(en) != "english"))
    return kept.withColumns(tidy)


def merge_first_wins(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Additive merge; the first row of a key stays, imports never overwrite.

    Rows carry ``ord``, their place in the file. The winner of a key is the smallest
    (source, ord), found by a partial aggregate, so a key with many copies is reduced
    before it is shuffled. ``added`` marks rows that came in with the import."""
    cols = ["ord", *TERM_COLUMNS]
    both = base.select(F.lit(0).alias("src"), *cols).unionByName(
        extra.select(F.lit(1).alias("src"), *cols)
    )
    row = F.struct("src", *cols)
    first = both.groupBy(term_key(F.col("english")).alias("key")).agg(F.min(row).alias("t"))
    return first.select(
        "key", "t.src", *[f"t.{c}" for c in cols], (F.col("t.src") == 1).alias("added")
    )


def search(terms: DataFrame, wanted: str) -> DataFrame:
    """terms with the text on either side; an empty query keeps all."""
    q = wanted.strip().lower()
    if not q:
        return terms
    hit = F.lit(False)
    for side in ("english", "vietnamese"):
        hit = hit | F.contains(F.lower(F.coalesce(side, F.lit(""))), F.lit(q))
    return terms.filter(hit)


def clashes(terms: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose English side another term already has, in any case."""
    # a key of any number of copies is reduced to its smallest and largest place
    taken = terms.groupBy(term_key(F.col("english")).alias("key")).agg(
        F.min("ord").alias("_lo"), F.max("ord").alias("_hi")
    )
    proposed = edits.withColumn("key", term_key(F.col("english"))).join(taken, "key")
    others = (F.col("_lo") != F.col("ord")) | (F.col("_hi") != F.col("ord"))
    return proposed.filter(others).drop("_lo", "_hi")


def _needles(terms: DataFrame) -> DataFrame:
    needle = term_key(F.col("english"))
    return terms.select("ord", needle.alias("needle")).filter(F.length("needle") >= 2)


def _anchors(needles: DataFrame) -> DataFrame:
    """(cls, gram) pairs that lead to each needle; ``cls`` is the gram length.

    A short needle has its first characters. A longer one takes the q consecutive grams it
    shares least with other needles, so that a common prefix makes no hot gram."""
    size = F.length("needle")
    first = F.least(size, F.lit(HEAD))
    short = needles.filter(size <= EXACT_LENGTH).select(
        "ord", "needle", F.lit(False).alias("cut"), first.alias("q"), F.left("needle", first).alias("gram")
    )
    q = F.lit(None).cast("int")
    for least, n in LONG_CLASSES:
        q = F.when(size >= least, n).otherwise(q)
    placed = needles.filter(size > EXACT_LENGTH).withColumn("q", q)
    all_grams = F.transform(
        F.sequence(F.lit(0), size - F.col("q")),
        lambda i: F.substring(F.col("needle"), i + 1, F.col("q")),
    )
    grams = placed.select("ord", "needle", "q", F.posexplode_outer(all_grams).alias("at", "gram"))
    shared = grams.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n"))
    per_term = (
        grams.join(shared, ["q", "gram"])
        .groupBy("ord", "needle", "q")
        .agg(F.sort_array(F.collect_list(F.struct("at", "gram", "n"))).alias("g"))
    )

    def cost(i: Column) -> Column:
        window = F.slice("g", i + 1, F.col("q"))
        total = F.aggregate(window, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
        return F.struct(total.alias("cost"), i.alias("i"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.size("g") - F.col("q")), cost))["i"]
    chosen = F.transform(F.slice("g", best + 1, F.col("q")), lambda x: x["gram"])
    long = per_term.select(
        "ord", "needle", F.lit(True).alias("cut"), "q", F.explode_outer(chosen).alias("gram")
    )
    return short.unionByName(long).distinct()


def _text_grams(classes: list[tuple[bool, int]]) -> Column:
    """Distinct grams of a text: for short needles what stands at every position (``seen``, its
    first characters being the gram), for cut needles consecutive grams; one linear pass per
    class."""

    def grams(cut: bool, q: int) -> Column:
        if cut:
            found = F.regexp_extract_all(F.col("_low"), F.lit(f"(?s).{{{q}}}"), F.lit(0))
        else:
            most = EXACT_LENGTH if q == HEAD else q
            found = F.regexp_extract_all(F.col("_low"), F.lit(f"(?s)(?=(.{{{q},{most}}}))."), F.lit(1))
        return F.transform(
            F.array_distinct(found),
            lambda g: F.struct(
                F.lit(cut).alias("cut"), F.lit(q).alias("q"),
                (g if cut else F.left(g, F.lit(q))).alias("gram"), g.alias("seen"),
            ),
        )

    return F.concat(*[grams(*c) for c in classes])


def _hot_grams(grams: DataFrame, anchors: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame | None:
    """Grams that many texts hold, from a sample; None where texts are too few to matter. Of
    ``HOT_SAMPLE`` texts and a share of ``HOT_SHARE`` these are a few thousand at most."""
    total = texts.count()
    if total < HOT_TEXTS:
        return None
    share = int(HOT_SAMPLE / total * (1 << 30))
    some = grams.filter(F.pmod("_row", F.lit(1 << 30)) < share).select("_row", *by).distinct()
    met = some.join(anchors.select(*by).distinct(), by, "left_semi")
    return met.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= HOT_SHARE * HOT_SAMPLE).select(*by)


def _proposals(grams: DataFrame, anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """(_row, ord, cut) for every gram that a text and a term share; a short term stands there
    whole. Anchors go to the texts where they are few. Otherwise both are shuffled, and a gram
    that many texts hold is dealt to several tasks, and its terms to each of them."""
    by = ["cut", "q", "gram"]
    anchors = anchors.select("ord", *by, F.when(~F.col("cut"), F.col("needle")).alias("short"))
    if anchors.count() <= BROADCAST_ANCHORS:
        anchors = F.broadcast(anchors)
    else:
        hot = _hot_grams(grams, anchors, texts, by)
        if hot is not None:
            hot = F.broadcast(hot.withColumn("_hot", F.lit(HOT_PARTS)))  # bounded by the sample
            part = F.pmod("_row", F.coalesce("_hot", F.lit(1))).cast("int")
            grams = grams.join(hot, by, "left").withColumn("_part", part).drop("_hot")
            last = F.coalesce("_hot", F.lit(1)) - 1
            anchors = anchors.join(hot, by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
            by = [*by, "_part"]
    met = grams.join(anchors, by)
    stands = F.col("cut") | F.coalesce(F.startswith("seen", "short"), F.lit(False))
    return met.filter(stands).select("_row", "ord", "cut").distinct()


class WordIndex:
    """Terms by a word they hold. Each word of a term (what stands between white space) lies inside
    one word of a text; a term of several words is found by the one that the fewest terms hold, of
    equals the longest, and whether the text has all of it is seen in the text."""

    def __init__(self, terms: list[tuple[int, str]]):
        self.terms = sorted(terms)
        split = [needle.split() for _, needle in self.terms]
        held = Counter(w for words in split for w in set(words))
        #: Every beginning of a word of the index, with the places of the terms that are the word
        #: and of those that have others too. White space alone stands at the empty word.
        self.places: dict[str, tuple[list[int], list[int]]] = {"": ([], [])}
        for place, ((_, needle), words) in enumerate(zip(self.terms, split)):
            word = min(words, key=lambda w: (held[w], -len(w)), default="")
            for n in range(1, len(word)):
                self.places.setdefault(word[:n], ([], []))
            self.places.setdefault(word, ([], []))[word != needle].append(place)
        self.memo: dict[str, tuple[list[int], list[int]]] = {}

    def inside(self, word: str) -> tuple[list[int], list[int]]:
        """Places of the terms that stand in a word of a text, in order, and of those of which
        only a word does."""
        known = self.memo.get(word)
        if known is not None:
            return known
        whole: set[int] = set()
        part: set[int] = set()
        get, size = self.places.get, len(word)
        for i in range(size):
            for j in range(i + 1, size + 1):
                places = get(word[i:j])
                if places is None:
                    break
                whole.update(places[0])
                part.update(places[1])
        found = (sorted(whole), sorted(part))
        if size <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def first(self, text: str, top: int | None) -> list[int]:
        """The first ``top`` terms of a text, in order."""
        met: set[int] = set()
        open_ = set(self.places[""][1])
        last = len(self.terms)  # ``top`` terms are known that do not come after this one
        for word in set(text.split()):
            whole, part = self.inside(word)
            if whole and whole[0] <= last:
                met.update(whole[: bisect_right(whole, last)])
                if top and len(met) > 2 * top:
                    met = set(sorted(met)[:top])
                    last = max(met)
            if part:
                open_.update(part)
        met.update(p for p in open_ if p <= last and self.terms[p][1] in text)
        return [self.terms[p][0] for p in (sorted(met)[:top] if top else sorted(met))]


def _match_in_tasks(low: DataFrame, needles: DataFrame, top: int | None) -> DataFrame:
    """(key, ord, rank) with all terms in every task, text by text."""
    terms = low.sparkSession.sparkContext.broadcast([(r.ord, r.needle) for r in needles.collect()])
    schema = T.StructType([low.schema[0], T.StructField("ord", needles.schema["ord"].dataType), T.StructField("rank", T.IntegerType())])
    name = low.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex(terms.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                found = [index.first(t, top) for t in some.column(1).to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(rows), pa.array([o for f in found for o in f], pa.int64()),
                        pa.array([n for f in found for n in range(1, len(f) + 1)], pa.int32()),
                    ],
                    [name, "ord", "rank"],
                )

    return low.mapInArrow(run, schema)


def match_terms(
    texts: DataFrame, key: str, text: str, terms: DataFrame, top: int | None = P.GLOSSARY_TOP
) -> DataFrame:
    """(key, ord, rank) for terms whose English side occurs anywhere in a text, in any
    case and regardless of word boundaries; per text the first ``top`` in glossary order. ``ord``
    is the term's own number, a bigint.

    A substring join that never compares every text with every term. Up to ``BROADCAST_TERMS``
    terms go to the tasks, indexed by a word of theirs, and meet each text there word by word
    (``WordIndex``); nothing is shuffled. With more, texts and terms meet in an equi-join on
    grams, each term represented by its rarest ones, and for longer terms ``contains`` decides.
    The texts themselves travel once, for what needs that decision. Each partition keeps ``top``
    terms of a text before anything is grouped by text.

    Texts may repeat and share keys, also null ones: each row has its own terms. Null texts have
    none."""
    needles = durable(_needles(terms).withColumn("ord", F.col("ord").cast("bigint")))
    if needles.count() <= BROADCAST_TERMS:
        low = texts.select(key, F.lower(F.col(text)).alias("_low")).filter("_low IS NOT NULL")
        return _match_in_tasks(low, needles, top)
    anchors = durable(_anchors(needles))
    kinds = sorted((r[0], r[1]) for r in anchors.select("cut", "q").distinct().collect())  # <= 8
    if not kinds:
        none = {"ord": F.lit(0).cast("bigint"), "rank": F.lit(0)}
        return texts.select(key).limit(0).withColumns(none)
    # Equal rows share a number, and so their terms; they part again at the end.
    row = F.xxhash64(key, text).alias("_row")
    low = texts.select(row, F.lower(F.col(text)).alias("_low")).filter("_low IS NOT NULL")
    # outer: an inner explode of a computed array is evaluated again in an inferred filter
    grams = low.select("_row", F.explode_outer(_text_grams(kinds)).alias("g"))
    grams = grams.filter("g.gram IS NOT NULL").select("_row", "g.cut", "g.q", "g.gram", "g.seen")
    proposed = durable(_proposals(grams, anchors, texts))
    checked = proposed.filter("cut").join(needles, "ord").join(low, "_row")
    checked = checked.filter(F.contains("_low", "needle")).select("_row", "ord").distinct()
    hits = proposed.filter("NOT cut").select("_row", "ord").unionByName(checked)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy("ord")))
    if top:
        ranked = ranked.filter(F.col("rank") <= top)
    return texts.select(key, row).join(ranked, "_row").select(key, "ord", "rank")


def prompt_lines(matched: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """The glossary part of a batch context; at most ``top`` lines per key."""
    line = F.concat(
        F.lit("- "), "english", F.lit(" → "), "vietnamese",
        F.when(F.col("note") != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise(""),
    )
    lines = matched.join(terms.select("ord", line.alias("line")), "ord")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "line")))
    return lines.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("terminology")
    )
