"""Translating units with an injected translator: batches, retries, page recovery.

A translator is any picklable ``translate(prompt, context) -> answer``. Spark keeps
the bookkeeping: each recovery step is a round over the units still open, prompts are
built, answers parsed and checked by column expressions, and only the call itself
runs in Python. Calls cost money and may answer differently next time, so every
round is made durable before anything reads it twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import provider as PV
from ..functions import response as R
from ..functions import text as X
from .staging import durable, pinned
from .validate import with_reason

Translator = Callable[[str, str], str]

BASE_CONTEXT = "Translate English medical prose to professional Vietnamese; keep terms, numbers and markup."
DIRECT = "Translate this fragment. Keep every placeholder such as __KEEP_MARKUP_000__ unchanged.\n\n"
RETRY = "Translate the whole unit and keep every placeholder. The last answer was rejected: %s\n\n%s"
BATCH = "Return only a JSON array of objects with id and translation.\n"
SENTENCES = "Translate every sentence. Return only a JSON array of strings, same order and count.\n"
MARKED = "Translate the text of each unit and keep every unit marker.\n\n"
DIRECT_CHARS = 80
RETRIES = 3


def failover(providers: list[tuple[str, Translator]]) -> Translator:
    """C14: try providers in order; all failures end in one error that names each."""

    def translate(prompt: str, context: str) -> str:
        failures = []
        for name, call in providers:
            try:
                return call(prompt, context)
            except Exception as e:
                failures.append(f"{name}: {e}")
        raise RuntimeError("all providers failed\n" + "\n".join(failures))

    return translate


def observed(rows: DataFrame, progress: Observation) -> DataFrame:
    """Done and kept-source counts of a run, readable from ``progress.get`` once it ran."""
    return rows.observe(
        progress,
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("status") == "DONE").alias("done"),
        F.count_if(F.col("status") == "SOURCE_ONLY").alias("kept_source"),
    )


@contextmanager
def labelled(spark: SparkSession, stage: str) -> Iterator[None]:
    """Jobs started inside carry the stage name in the UI and the event log."""
    spark.sparkContext.setJobDescription(stage)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)


def with_backoff(call: Translator, attempts: int = 3, unit_seconds: float = 0.7) -> Translator:
    """Repeat a call that fails for a transient reason, waiting longer each time."""
    from ..functions.patterns import TRANSIENT_WORDS

    def translate(prompt: str, context: str) -> str:
        for attempt in range(1, attempts + 1):
            try:
                return call(prompt, context)
            except Exception as e:
                known = any(w in str(e).lower() for w in TRANSIENT_WORDS)
                if attempt == attempts or not known:
                    raise
                time.sleep(unit_seconds * attempt)
        raise AssertionError("unreachable")

    return translate


def ask(
    df: DataFrame, translator: Translator, prompt: str = "prompt", context: str = "context",
    in_flight: int | None = None, stop_on_hold: bool = False,
) -> DataFrame:
    """Add ``answer`` and ``error``; a failed call never fails the task.

    ``stop_on_hold``: after a failure that puts the provider on hold, a task calls no more and
    leaves both null.

    T2: ``in_flight`` bounds the calls running at once (a local engine wants one per
    machine, a metered provider a few); by default every task calls."""
    if in_flight:
        df = df.repartition(in_flight)
    held = [False]  # of one task: each gets a copy of its own

    def call(prompt: str, context: str) -> tuple[str | None, str | None]:
        if held[0]:
            return None, None
        try:
            return translator(prompt, context), None
        except Exception as e:
            error = str(e) or type(e).__name__
            held[0] = stop_on_hold and PV.hold_ms(error) > 0
            return None, error

    # A plain function gets about a hundred rows at a time, and of a row only prompt and context;
    # an Arrow batch has 10,000 whole rows, however long. Not deterministic: called once a row.
    said = F.udf(call, "answer string, error string", useArrow=False).asNondeterministic()
    asked = df.withColumn("_said", said(F.col(prompt), F.col(context)))
    return asked.select(*df.columns, "_said.answer", "_said.error")


def ask_in_order(
    df: DataFrame, providers: list[tuple[str, Translator]], holds: DataFrame | None = None,
    now_ms: Callable[[], int] = lambda: int(time.time() * 1000), in_flight: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``ask`` with failover and holds, in a round for each provider.

    ``holds`` (provider, until_ms) is read before each round: a provider on hold is left out,
    and all rows that are still open go to the next one. In a round a task stops calling after
    a failure that earns a hold, and the longest of them becomes a row of the holds that the
    next round and the next call of this function read. Returns the rows with ``answer``,
    ``provider`` and ``error`` (the failures, one to a line; null where there is an answer), and
    the holds."""
    spark = df.sparkSession
    schema = "provider string, until_ms bigint"
    kept = spark.createDataFrame([], schema) if holds is None else holds.select("provider", "until_ms")
    columns = df.columns
    none = F.lit(None).cast("string")
    open_rows = df.withColumn("failures", F.array().cast("array<string>"))
    settled: list[DataFrame] = []
    for name, call in providers:
        until = kept.filter(F.col("provider") == name).agg(F.max("until_ms")).first()[0]
        if until is not None and until > now_ms():
            continue
        asked = durable(ask(open_rows, call, in_flight=in_flight, stop_on_hold=True))
        settled.append(asked.filter("answer IS NOT NULL").withColumn("provider", F.lit(name)))
        told = F.when(
            F.col("error").isNotNull(), F.array_append("failures", F.concat(F.lit(f"{name}: "), "error"))
        ).otherwise(F.col("failures"))
        open_rows = asked.filter("answer IS NULL").withColumn("failures", told).drop("answer", "error")
        hold = asked.agg(F.max(PV.cooldown_ms(F.col("error")))).first()[0]
        if hold:
            kept = kept.unionByName(spark.createDataFrame([(name, now_ms() + hold)], schema))
    out = open_rows.select(
        *columns, none.alias("answer"), none.alias("provider"),
        F.concat_ws("\n", F.lit("all providers failed"), F.array_join("failures", "\n")).alias("error"),
    )
    for rows in settled:
        out = out.unionByName(rows.select(*columns, "answer", "provider", none.alias("error")))
    return out, kept.groupBy("provider").agg(F.max("until_ms").alias("until_ms"))


def batch_prompts(batched: DataFrame, keys: list[str]) -> DataFrame:
    """C4: one prompt per batch, at most eight lines, in unit order."""
    line = F.concat(
        F.lit('{"id":"'), "id", F.lit('","source":"'),
        X.escape_json(M.protect_markup(F.col("inner"))), F.lit('"}'),
    )
    lines = F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return batched.groupBy(*keys).agg(F.concat(F.lit(BATCH), body).alias("prompt"))


def batch_candidates(
    batched: DataFrame, keys: list[str], translator: Translator,
    contexts: DataFrame | None = None, in_flight: int | None = None,
) -> DataFrame:
    """(id, candidate) for the units a batch answer covers with intact markup.
    A batch that fails gives no rows and leaves its units to the single-unit rounds."""
    batched = durable(batched)  # read for the prompts and for what the answers belong to
    prompts = batch_prompts(batched, keys)
    if contexts is not None:
        extra = F.coalesce(F.concat(F.lit("\n\n"), "terminology"), F.lit(""))
        prompts = prompts.join(contexts, keys, "left").withColumn(
            "context", F.concat(F.lit(BASE_CONTEXT), extra)
        ).drop("terminology")
    else:
        prompts = prompts.withColumn("context", F.lit(BASE_CONTEXT))
    answers = durable(ask(prompts, translator, in_flight=in_flight))
    items = answers.select(
        F.posexplode_outer(R.id_texts(F.col("answer"))).alias("place", "x")
    ).select("place", "x.*")
    known = items.filter("id IS NOT NULL").join(batched.select("id", "inner"), "id")
    restored = M.restore_markup(F.col("translation"), M.markup_tokens(F.col("inner")))
    usable = pinned(known, {"candidate": restored}).filter(~X.is_blank(F.col("candidate")))
    # Of an id that is answered twice, the last answer that can be restored counts.
    return usable.groupBy("id").agg(F.max_by("candidate", "place").alias("candidate"))


def _check(df: DataFrame, answer: Column, step: str) -> DataFrame:
    """Restore, clean and validate an answer; keeps the reason for the next prompt."""
    restored = X.clean_fragment(M.restore_markup(answer, F.col("tokens")))
    tried = pinned(df, {"attempt": restored})
    checked = with_reason(tried, "inner", "attempt").drop("reason_total", "reason_covered")
    return checked.withColumns(
        {
            "translation": F.when(F.col("reason").isNull(), F.col("attempt")),
            "step": F.lit(step),
        }
    )


_KEPT = ("id", "file", "ordinal", "inner", "source_hash", "context", "tokens", "protected")


def translate_units(units: DataFrame, translator: Translator, candidates: DataFrame | None = None, in_flight: int | None = None) -> DataFrame:
    """Every unit through the recovery ladder, to a state row each.

    Steps: direct for short units, the batch candidate, up to three retries that quote
    the reason, sentence by sentence, direct again; then the source is kept
    (SOURCE_ONLY). Each step runs only on units still open, at most six calls per unit."""
    base = units.select(
        "id", "file", "ordinal", "inner", "source_hash",
        (F.col("context") if "context" in units.columns else F.lit(BASE_CONTEXT)).alias("context"),
        M.markup_tokens(F.col("inner")).alias("tokens"),
        M.protect_markup(F.col("inner")).alias("protected"),
    )
    given = base.withColumn("candidate", F.lit(None).cast("string"))
    if candidates is not None:
        given = base.join(candidates, "id", "left")
    finished: list[DataFrame] = []

    def settle(round_: DataFrame) -> DataFrame:
        done = durable(round_)
        finished.append(done.filter("translation IS NOT NULL"))
        return done.filter("translation IS NULL")

    direct_prompt = F.concat(F.lit(DIRECT), "protected")
    short = F.length(X.strip_markup(F.col("inner"))) <= DIRECT_CHARS
    given = durable(given.withColumn("short", short))  # read by the first two steps
    first = ask(given.filter("short").withColumn("prompt", direct_prompt), translator, in_flight=in_flight)
    open_short = settle(_check(first, F.col("answer"), "direct"))
    waiting = given.filter("NOT short").select(*_KEPT, "candidate").unionByName(
        open_short.select(*_KEPT, "candidate")
    )
    tried = with_reason(
        pinned(waiting, {"attempt": X.clean_fragment(F.col("candidate"))}), "inner", "attempt"
    )
    open_units = settle(
        tried.withColumns(
            {"translation": F.when(F.col("reason").isNull(), F.col("attempt")), "step": F.lit("batch")}
        ).drop("reason_total", "reason_covered")
    )
    for n in range(1, RETRIES + 1):
        prompt = F.format_string(RETRY, F.coalesce("reason", F.lit("")), F.col("protected"))
        asked = ask(open_units.select(*_KEPT, prompt.alias("prompt")), translator, in_flight=in_flight)
        open_units = settle(_check(asked, F.col("answer"), f"retry {n}"))
    sentences = X.split_sentences(F.col("protected"))
    listed = F.transform(
        F.col("sentences"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)
    )
    many = F.concat(F.lit(SENTENCES), F.array_join(listed, "\n"))
    parts = pinned(open_units.select(*_KEPT), {"sentences": sentences})
    one = F.size("sentences") <= 1
    asked = ask(parts.withColumn("prompt", F.when(one, direct_prompt).otherwise(many)), translator, in_flight=in_flight)
    answers = F.transform(
        F.from_json(X.json_array_slice(F.col("answer")), "array<string>"), X.trim_low
    )
    whole = (F.size(answers) == F.size("sentences")) & F.forall(answers, lambda s: s != "")
    joined = F.when(one, F.col("answer")).when(whole, F.array_join(answers, " "))
    open_units = settle(_check(asked, joined, "sentences"))
    last = ask(open_units.select(*_KEPT).withColumn("prompt", direct_prompt), translator, in_flight=in_flight)
    failed = settle(_check(last, F.col("answer"), "last"))

    cols = ["id", "file", "ordinal", "source_hash", "translation", "step", "reason"]
    done = finished[0].select(*cols)
    for f in finished[1:]:
        done = done.unionByName(f.select(*cols))
    done = done.withColumns({"status": F.lit("DONE"), "attempts": F.lit(0)})
    kept = failed.select(*cols).withColumns(
        {"translation": F.lit(""), "status": F.lit("SOURCE_ONLY"), "attempts": F.lit(3)}
    )
    return done.unionByName(kept)


def translate_pages(units: DataFrame, translator: Translator, in_flight: int | None = None) -> DataFrame:
    """(page, unit, source) to (page, text, failed), in three steps.

    The page as marked blocks; what is missing as JSON items; what is still missing one
    by one. A page counts when every unit has a text; otherwise it keeps its source and
    is marked, so that the next run asks again."""
    ordered = F.sort_array(F.collect_list(F.struct("unit", "source")))
    pages = units.groupBy("page").agg(ordered.alias("u")).withColumns(
        {
            "sources": F.transform("u", lambda x: x["source"]),
            "context": F.lit(BASE_CONTEXT),
        }
    )
    marked = pages.withColumn("prompt", F.concat(F.lit(MARKED), R.build_markers(F.col("sources"))))
    first = durable(ask(marked.select("page", "sources", "context", "prompt"), translator, in_flight=in_flight))
    n = F.size("sources")
    got = pinned(first, {"texts": R.parse_markers(F.col("answer"), n)})
    complete = F.size(F.array_except(F.sequence(F.lit(0), n - 1), F.map_keys("texts"))) == 0
    good = got.filter(complete).select("page", "sources", "texts")
    rest = got.filter(~complete).select("page", "sources", "context")

    lines = F.transform(
        "sources",
        lambda s, i: F.to_json(F.struct(i.cast("string").alias("id"), s.alias("source"))),
    )
    as_json = F.concat(F.lit(BATCH), F.array_join(lines, "\n"))
    second = durable(ask(rest.withColumn("prompt", as_json), translator, in_flight=in_flight))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    parsed = pinned(second, {"texts": F.coalesce(R.parse_items(F.col("answer"), n), none)})
    missing = F.array_except(F.sequence(F.lit(0), n - 1), F.map_keys("texts"))
    single = parsed.select(
        "page", "context", "sources", F.explode_outer(missing).alias("unit")
    ).filter("unit IS NOT NULL")
    item = F.to_json(
        F.struct(F.lit("0").alias("id"), F.get("sources", F.col("unit")).alias("source"))
    )
    asked = ask(
        single.select("page", "unit", "context", F.concat(F.lit(BATCH), item).alias("prompt")), translator,
        in_flight=in_flight,
    )
    third = durable(asked)
    texts = third.select(
        "page", "unit", R.parse_items(F.col("answer"), F.lit(1))[0].alias("text")
    ).filter("text IS NOT NULL")
    singles = texts.groupBy("page").agg(
        F.map_from_entries(F.collect_list(F.struct("unit", "text"))).alias("more")
    )
    recovered = parsed.select("page", "sources", "texts").join(singles, "page", "left")
    merged = recovered.withColumn(
        "texts", F.when(F.col("more").isNull(), F.col("texts")).otherwise(F.map_concat("texts", "more"))
    ).drop("more")
    everything = good.unionByName(merged)
    full = F.size("texts") == n
    translated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("texts")[i])
    return everything.select(
        "page",
        R.build_markers(F.when(full, translated).otherwise(F.col("sources"))).alias("text"),
        (~full).alias("failed"),
    )
