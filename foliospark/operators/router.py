"""Provider failover over a call log: eligibility, order and cooldown replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import provider as PV
from ..functions import text as X
from . import sequence as SQ
from .staging import durable

HOUR_MS = 60 * 60 * 1000


def eligible(providers: DataFrame) -> DataFrame:
    """an endpoint and a model, and a key unless the provider is local."""
    local = F.col("endpoint").startswith(P.OFFLINE_SCHEME)
    return providers.filter(
        ~X.is_blank(F.col("endpoint"))
        & ~X.is_blank(F.col("model"))
        & (local | ~X.is_blank(F.col("api_key_ref")))
    )


def with_profile(slots: DataFrame, saved: DataFrame, owner: str) -> DataFrame:
    """``slots`` (owner, provider, ...) with endpoint, model and key reference as saved
    for (owner, provider), blank or missing values being the provider's defaults. A provider
    that has none keeps nulls; of repeated saved rows the greatest value counts."""
    defaults = slots.sparkSession.createDataFrame(
        [(name, endpoint, model) for _, name, endpoint, model in P.PROVIDERS],
        "provider string, _endpoint string, _model string",
    )

    def filled(c: str) -> Column:
        return F.when(~X.is_blank(F.col(c)), X.trim_low(F.col(c)))

    own = saved.groupBy(owner, "provider").agg(
        *[F.max(filled(c)).alias(c) for c in ("endpoint", "model", "api_key_ref")]
    )
    joined = slots.join(own, [owner, "provider"], "left")
    known = joined.join(F.broadcast(defaults), "provider", "left")  # five rows
    return known.select(
        *slots.columns,
        F.coalesce("endpoint", "_endpoint").alias("endpoint"),
        F.coalesce("model", "_model").alias("model"),
        F.coalesce("api_key_ref", F.lit("")).alias("api_key_ref"),
    )


def provider_order(profiles: DataFrame, group: str, free_only: bool, allow_paid: bool) -> DataFrame:
    """Profiles of a user in call order: local first, then by rank, the
    first of equal (name, model, key) entries, paid ones only when allowed.

    Equal entries meet in an aggregate with partial reduction, not in a window."""
    allowed = eligible(profiles)
    if free_only and not allow_paid:
        allowed = allowed.filter(PV.is_free_profile(F.col("name"), F.col("model")))
    local = F.when(F.col("endpoint").startswith(P.OFFLINE_SCHEME), 0).otherwise(1)
    return (
        allowed.groupBy(group, "name", "model", "api_key_ref", "endpoint")
        .agg(F.min(F.struct(local.alias("tier"), F.col("rank"))).alias("place"))
        .select(group, "name", "model", "endpoint", "place.tier", "place.rank")
    )


def cooldown_triggers(calls: DataFrame, provider: str, ts_ms: str, order: str, cooldown: str) -> DataFrame:
    """T4: failures that put a provider on hold, as (provider, ts_ms, until_ms).

    A failure while the provider is on hold cannot happen, so each trigger hides the
    failures up to its end: a greedy chain over time. Failures of one millisecond
    collapse to the first of them before anything is grouped, which bounds a span of
    time of one provider however many calls it holds. The spans lie between splitters of
    all failures, so they fit even if one provider has most of them or a time is far off."""
    failures = calls.filter(F.col(cooldown) > 0)
    first = failures.groupBy(provider, ts_ms).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(cooldown).alias("c"))).alias("f")
    )
    spans = first.select(
        provider, ts_ms, (F.col(ts_ms) + F.col("f.c")).alias("until_ms"), F.col("f.o").alias("trigger")
    )
    spans = durable(spans)
    blocks = SQ.splitters(spans, ts_ms, SQ.ROWS_PER_BLOCK)
    picked = SQ.chain(spans, provider, ts_ms, "until_ms", blocks)
    return spans.join(picked, [provider, ts_ms], "left_semi")


def replay(calls: DataFrame, provider: str, ts_ms: str, order: str, cooldown: str) -> DataFrame:
    """calls with ``skipped`` set where the provider was on hold.

    Holds are cut at hour borders, so calls and holds meet on (provider, hour) and a
    hot provider spreads over its hours. One hour has at most 60 holds."""
    holds = cooldown_triggers(calls, provider, ts_ms, order, cooldown)
    hour = F.floor(F.col(ts_ms) / F.lit(HOUR_MS))
    per_hour = (
        holds.select(
            provider,
            F.explode(
                F.sequence(hour, F.floor((F.col("until_ms") - 1) / F.lit(HOUR_MS)))
            ).alias("_h"),
            F.struct(F.col(ts_ms).alias("a"), F.col("until_ms").alias("z"), "trigger").alias("_x"),
        )
        .groupBy(provider, "_h")
        .agg(F.collect_list("_x").alias("_holds"))
    )
    hidden = F.exists(
        "_holds",
        lambda x: (F.col(ts_ms) >= x["a"])
        & (F.col(ts_ms) < x["z"])
        & ((F.col(ts_ms) > x["a"]) | (F.col(order) > x["trigger"])),
    )
    joined = calls.withColumn("_h", hour).join(per_hour, [provider, "_h"], "left")
    return joined.withColumn("skipped", F.coalesce(hidden, F.lit(False))).drop("_h", "_holds")


def route(calls: DataFrame, group: str, ts_ms: str, order: str, failures: list[str]) -> DataFrame:
    """``calls`` with the provider that answers each: ``served`` (its place in the
    list, from 0; null if none does), ``failed`` and ``held`` (providers that failed and that
    were on hold before).

    ``failures`` has a column for each provider, in call order: null where it would answer a
    call, else how long this failure keeps it out (0: not at all). A call goes to the first
    provider that is not on hold, and on to the next one where it fails; (group, ts_ms, order)
    tells the order of calls.

    The holds depend on one another, but only forwards: what reaches a provider is settled by
    those before it. So the list is walked once, and the holds of a provider are a chain over
    the calls that reach it, which blocks of time solve side by side (``cooldown_triggers``);
    no group is ever in one task."""
    open_calls = calls.withColumns({
        "failed": F.lit(0), "held": F.lit(0), "served": F.lit(None).cast("int"),
    })
    settled = []
    for place, failure in enumerate(failures):
        open_calls = durable(open_calls)
        seen = replay(open_calls, group, ts_ms, order, failure)
        answers = ~F.col("skipped") & F.col(failure).isNull()
        seen = durable(seen.withColumns({
            "served": F.when(answers, place),
            "failed": F.col("failed") + F.when(F.col("skipped") | answers, 0).otherwise(1),
            "held": F.col("held") + F.col("skipped").cast("int"),
        }).drop("skipped"))
        settled.append(seen.filter("served IS NOT NULL"))
        open_calls = seen.filter("served IS NULL")
    out = open_calls
    for rows in settled:
        out = out.unionByName(rows)
    return out
