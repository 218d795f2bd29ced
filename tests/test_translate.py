"""The translation ladder with translators that fail in different ways, and the streams."""

import json
import os
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import jobs
from foliospark.operators import offline as O
from foliospark.operators import translate as TR
from foliospark.sources import state
from foliospark.streaming import cooldown, incremental

# workers do not have this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = "First sentence <b>bold</b> is here. Second one has 5% of it. Third one closes the paragraph here."


def units(spark, *inner):
    df = spark.createDataFrame([(f"u{i}", "f", i, t, True) for i, t in enumerate(inner)], "id string, file string, ordinal int, inner string, translatable boolean")
    return df.withColumn("source_hash", X.content_hash(F.col("inner")))


def same(text):
    return text


def by_sentence(prompt, context):
    """Loses a sentence unless asked for each one on its own."""
    import json

    if prompt.startswith("Translate every sentence"):
        lines = prompt.split("\n")[1:]
        return json.dumps([x.split(". ", 1)[1] for x in lines])
    return prompt.rpartition("\n\n")[2].split(".")[0] + "."


def broken(prompt, context):
    raise RuntimeError("HTTP 429")


def test_ladder(spark):
    src = units(spark, "Short title", TEXT, "<p></p>")
    echo = O.prompt_adapter(same)
    batched = src.withColumns({"book": F.lit("b"), "batch_no": F.lit(0)})
    found = TR.batch_candidates(batched, ["book", "batch_no"], echo)
    rows = {r.id: r for r in TR.translate_units(src, echo, found).collect()}
    assert (rows["u0"].step, rows["u0"].translation) == ("direct", "Short title")
    assert (rows["u1"].step, rows["u1"].translation, rows["u1"].status) == ("batch", TEXT, "DONE")
    assert rows["u2"].status == "SOURCE_ONLY" or rows["u2"].translation == "<p></p>"


def test_last_usable_answer_of_a_repeated_id_counts(spark):
    src = units(spark, "Short title here", "<b>Short title</b>")
    batched = src.withColumns({"book": F.lit("b"), "batch_no": F.lit(0)})

    def twice(prompt, context):
        items = [{"id": u, "translation": t} for u, t in (("u0", "zz first"), ("u0", "aa last"), ("u1", "good __KEEP_MARKUP_000__ x __KEEP_MARKUP_001__"), ("u1", "no markup"))]
        return json.dumps(items)

    found = {r.id: r.candidate for r in TR.batch_candidates(batched, ["book", "batch_no"], twice).collect()}
    assert found["u0"] == "aa last" and found["u1"] == "good <b> x </b>"


def test_ladder_by_sentences(spark):
    r = TR.translate_units(units(spark, TEXT), by_sentence).first()
    assert (r.step, r.translation, r.status) == ("sentences", TEXT, "DONE")


def test_ladder_gives_up(spark):
    r = TR.translate_units(units(spark, TEXT), TR.failover([("a", broken), ("b", broken)])).first()
    assert (r.status, r.translation, r.attempts) == ("SOURCE_ONLY", "", 3)


def test_progress_and_bounds(spark):
    from pyspark.sql import Observation

    seen = Observation("units")
    with TR.labelled(spark, "translate"):
        rows = TR.observed(TR.translate_units(units(spark, "Short title", TEXT), O.prompt_adapter(same)), seen)
        rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"units": 2, "done": 2, "kept_source": 0}
    asked = TR.ask(spark.range(9).selectExpr("cast(id as string) prompt", "'' context"), lambda p, c: p, in_flight=3)
    assert asked.rdd.getNumPartitions() == 3 and asked.filter("answer = prompt").count() == 9


def test_failover_and_backoff():
    seen = []

    def flaky(prompt, context):
        seen.append(1)
        if len(seen) < 3:
            raise RuntimeError("Connection reset")
        return "ok"

    assert TR.with_backoff(flaky, unit_seconds=0)("p", "c") == "ok" and len(seen) == 3
    assert TR.failover([("a", broken), ("b", lambda p, c: p)])("x", "") == "x"
    with pytest.raises(RuntimeError, match="a: HTTP 429"):
        TR.failover([("a", broken)])("x", "")


def test_offline_adapter():
    call = O.prompt_adapter(str.upper)
    assert call('do\n{"id":"1","source":"a<b>c</b>"}\n{"id":"2","source":"x"}', "") == (
        '[{"id": "1", "translation": "A<b>C</b>"}, {"id": "2", "translation": "X"}]'
    )
    assert call("t\n\n[[[UNIT_0]]]\none\n[[[UNIT_1]]]\ntwo __KEEP_MARKUP_000__", "") == "[[[UNIT_0]]]\nONE\n[[[UNIT_1]]]\nTWO __KEEP_MARKUP_000__"
    assert call("Translate:\n\nfragment &amp; 12", "") == "FRAGMENT &amp; 12"
    with pytest.raises(ValueError):
        call("1234", "")
    assert O.chunks("aaaa. bbbb. cc", 10) == ["aaaa.", "bbbb. cc"]


def test_pages(spark):
    rows = [(p, u, f"text {p}.{u}" if (p, u) != (2, 1) else "poison") for p in (1, 2, 3) for u in range(3)]

    def lossy(prompt, context):
        if "poison" in prompt and "[[[" not in prompt:
            raise RuntimeError("no")
        answer = O.prompt_adapter(same)(prompt, context)
        return answer if "text 1." in prompt else answer.replace("UNIT_1", "UNIT_7").replace('"id": "1"', '"id": "z"')

    df = spark.createDataFrame(rows, "page int, unit int, source string")
    got = {r.page: r for r in TR.translate_pages(df, lossy).collect()}
    want = lambda p: "\n".join(f"[[[UNIT_{u}]]]\n{s}" for q, u, s in rows if q == p)
    assert {p: (r.text, r.failed) for p, r in got.items()} == {1: (want(1), False), 2: (want(2), True), 3: (want(3), False)}


def test_incremental_stream(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "state")
    calls = []

    def translate(open_units):
        calls.append(open_units.count())
        return open_units.withColumns({"translation": F.upper("inner"), "status": F.lit("DONE"), "attempts": F.lit(0)})

    schema = units(spark, "x").schema

    def run(*inner):
        units(spark, *inner).write.mode("append").parquet(str(inbox))
        q = incremental.run_incremental(spark.readStream.schema(schema).parquet(str(inbox)), folder, str(tmp_path / "cp"), translate)
        q.awaitTermination()

    run("one text", "two text")
    run("one text", "two text", "three text")
    run("one text", "changed text")
    assert calls == [2, 1, 1]
    rows = incremental.latest_state(spark, folder).collect()
    assert sorted(r.translation for r in rows) == ["CHANGED TEXT", "ONE TEXT", "THREE TEXT", "TWO TEXT"]
    assert incremental.latest_state(spark, folder, before=1).count() == 2


def test_incremental_state_is_read_by_bucket(spark, tmp_path, monkeypatch):
    """With ten times the state a batch of the same size reads no more; runs are merged; an
    epoch that is repeated takes the place of its first try."""
    monkeypatch.setattr(incremental, "BUCKET_ROWS", 50)
    monkeypatch.setattr(incremental, "FAN", 3)
    folder = str(tmp_path / "state")

    def rows(low, high, text, epoch):
        df = spark.range(low, high).selectExpr("cast(id as string) id", "'f' file", "'h' source_hash", f"'{text}' translation", "'DONE' status", "0 attempts")
        return df.withColumn("epoch", F.lit(epoch).cast("bigint"))

    def read_bytes():
        live = incremental.runs(spark, folder)
        ids = spark.createDataFrame([("7",), ("8",)], "id string")
        total = 0
        for run, buckets in incremental.touched(spark, folder, live, ids):
            for b in buckets:
                total += sum(f.stat().st_size for f in (tmp_path / "state" / run.folder / f"bucket={b}").glob("*.parquet"))
        return total, sum(f.stat().st_size for f in (tmp_path / "state").rglob("*.parquet"))

    incremental._add(rows(0, 400, "a", 0), folder, 0, 0, 0)
    small, _ = read_bytes()
    incremental._add(rows(400, 4000, "b", 1), folder, 0, 1, 1)
    more, _ = read_bytes()
    assert small < more <= 3.5 * small
    incremental._add(rows(7, 8, "c", 2), folder, 0, 2, 2)
    incremental._add(rows(7, 9, "d", 2), folder, 0, 2, 2)
    incremental.compact(spark, folder)
    live = incremental.runs(spark, folder)
    assert [(r.level, r.first, r.last) for r in live] == [(1, 0, 2)] and live[0].buckets == 128
    merged, whole = read_bytes()
    assert merged <= 2.5 * small and whole > 10 * merged
    ids = spark.createDataFrame([("7",), ("8",), ("9",)], "id string")
    got = {r.id: r.translation for r in incremental.latest_state(spark, folder, ids=ids).collect()}
    assert (got["7"], got["8"], got["9"]) == ("d", "d", "a")
    assert incremental.latest_state(spark, folder).count() == 4000
    before = incremental.latest_state(spark, folder, before=2)  # the runs that were merged
    assert before.count() == 4000 and before.filter("id = '7'").first().translation == "a"


def test_page_job_resumes(spark, tmp_path):
    """Killed in its third slice; the second run asks only for the rest; a page without text
    ends the job before a call."""
    asked = str(tmp_path / "asked")
    units = spark.createDataFrame([(f, p, u, f"text {f}.{p}.{u}") for f, n in (("a", 5), ("b", 3)) for p in range(n) for u in range(2)], "file string, page bigint, unit int, source string")

    def note(prompt, fail):
        import os
        import uuid

        os.makedirs(asked, exist_ok=True)
        with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if fail and "text b.0" in prompt:
            os._exit(1)

    def dies(prompt, context):
        note(prompt, True)
        return O.prompt_adapter(same)(prompt, context)

    def works(prompt, context):
        note(prompt, False)
        if "text b.1" in prompt:
            raise RuntimeError("HTTP 503")
        return O.prompt_adapter(same)(prompt, context)

    def prompts():
        import os

        return [open(f"{asked}/{n}").read() for n in os.listdir(asked)]

    path = str(tmp_path / "pages")
    with pytest.raises(Exception):
        jobs.page_job(units, path, dies, pages_per_slice=2)
    first = {(r.file, r.page) for r in state.read_pages(spark, path).collect()}
    assert first == {("a", 0), ("a", 1), ("a", 2), ("a", 3)}
    for name in os.listdir(asked):
        os.remove(f"{asked}/{name}")
    got = {(r.file, r.page): (r.text, r.failed) for r in jobs.page_job(units, path, works, pages_per_slice=3).collect()}
    assert len(got) == 8 and got["b", 2] == ("[[[UNIT_0]]]\ntext b.2.0\n[[[UNIT_1]]]\ntext b.2.1", False)
    assert got["b", 1][1] and not got["b", 0][1]
    assert not any(f"text a.{p}." in x for x in prompts() for p in range(4))
    for name in os.listdir(asked):
        os.remove(f"{asked}/{name}")
    again = {(r.file, r.page): r.failed for r in jobs.page_job(units, path, dies, pages_per_slice=3).collect()}
    assert not any(again.values()) and all("text b.1" in x for x in prompts())
    empty = units.unionByName(spark.createDataFrame([("c", 0, 0, " ")], units.schema))
    with pytest.raises(Exception, match="no text layer: c"):
        jobs.page_job(empty, str(tmp_path / "none"), dies)
    with pytest.raises(Exception, match="no text layer: c"):
        jobs.page_job(empty.filter("file = 'c'"), str(tmp_path / "none"), dies)


def test_ask_in_order(spark):
    """A provider that earns a hold is left by its tasks and skipped by the next call; the
    failures of a row are told when no provider answers."""
    def limited(prompt, context):
        if prompt == "3":
            raise RuntimeError("HTTP 429 rate limit")
        return "first " + prompt

    def second(prompt, context):
        if prompt == "5":
            raise RuntimeError("HTTP 503")
        return "second " + prompt

    rows = spark.range(8).coalesce(1).selectExpr("cast(id as string) prompt", "'' context")
    clock = [1_000]
    got, holds = TR.ask_in_order(rows, [("a", limited), ("b", second)], now_ms=lambda: clock[0])
    found = {r.prompt: (r.provider, r.answer, r.error) for r in got.collect()}
    assert found["0"] == ("a", "first 0", None) and found["3"] == ("b", "second 3", None)
    assert found["7"] == ("b", "second 7", None)  # not sent to the first any more
    assert found["5"] == (None, None, "all providers failed\nb: HTTP 503")
    assert [tuple(r) for r in holds.collect()] == [("a", 61_000)]
    clock[0] = 60_000
    got, holds = TR.ask_in_order(rows, [("a", limited), ("b", second)], holds, now_ms=lambda: clock[0])
    assert {r.provider for r in got.collect()} == {"b", None}
    clock[0] = 61_000
    got, _ = TR.ask_in_order(rows.limit(2), [("a", limited), ("b", second)], holds, now_ms=lambda: clock[0])
    assert {r.provider for r in got.collect()} == {"a"}
    none, kept = TR.ask_in_order(rows, [], holds)
    assert none.filter("answer IS NULL").count() == 8 and kept.count() == 1


def test_cooldown_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", 1, 0, 1000), ("a", 2, 500, 0), ("a", 3, 1000, 0), ("b", 4, 100, 0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["provider", "call_id", "ts_ms", "cooldown"]))
    df.write.parquet(str(tmp_path / "calls"))
    calls = spark.readStream.schema(df.schema).parquet(str(tmp_path / "calls"))
    q = cooldown.mark_skipped(calls).writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.call_id: r.skipped for r in spark.table("held").collect()} == {1: False, 2: True, 3: False, 4: False}


def test_page_job_reads_units_as_often_for_many_slices(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    base = spark.createDataFrame([("a", p, u, f"text {p} {u}") for p in range(6) for u in range(2)], "file string, page bigint, unit int, source string")
    units = base.withColumn("source", F.udf(seen, "string").asNondeterministic()("source"))
    reads = []
    for n, size in enumerate((6, 1)):
        before = read.value
        got = jobs.page_job(units, str(tmp_path / f"p{n}"), lambda p, c: p.split("\n\n", 1)[1], pages_per_slice=size).collect()
        assert len(got) == 6 and not any(r.failed for r in got)
        reads.append(read.value - before)
    assert reads[0] == reads[1]


def test_ask_hands_over_prompts_only(spark):
    """A call for each row, and no batch of whole rows in Python."""
    calls = spark.sparkContext.accumulator(0)

    def answer(prompt, context):
        calls.add(1)
        if prompt == "p3":
            raise ValueError("no")
        return prompt.upper()

    rows = spark.range(20).selectExpr("id", "concat('p', id) AS prompt", "'c' AS context", "repeat('x', 1000) AS wide")
    asked = TR.ask(rows, answer)
    got = {r.id: (r.answer, r.error, len(r.wide)) for r in asked.filter("answer IS NOT NULL OR error IS NOT NULL").collect()}
    assert got == {i: (None, "no", 1000) if i == 3 else (f"P{i}", None, 1000) for i in range(20)}
    assert calls.value == 20
    assert "InPandas" not in asked._jdf.queryExecution().executedPlan().toString()


def test_translate_units_reads_units_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    some = units(spark, "Short one.", TEXT, "Short two.", TEXT + TEXT)
    some = some.withColumn("inner", F.udf(seen, "string").asNondeterministic()("inner"))
    got = TR.translate_units(some, lambda p, c: p.split("\n\n", 1)[1]).collect()
    assert len(got) == 4
    assert read.value == 4
