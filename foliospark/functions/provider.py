"""Provider columns: endpoints, error classes, retry delays, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import trim_low


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    low, hit = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def is_rate_limited(message: Column) -> Column:
    """P21."""
    return _any_of(message, P.QUOTA_WORDS)


def is_daily_quota(message: Column) -> Column:
    return _any_of(message, P.DAILY_WORDS)


def is_temporary_quota(message: Column) -> Column:
    return _any_of(message, P.TEMPORARY_WORDS)


def is_transient(message: Column) -> Column:
    return _any_of(message, P.TRANSIENT_WORDS)


def cooldown_ms(message: Column) -> Column:
    """T4: how long a failure keeps its provider out; 0 when it does not."""
    limited = F.when(is_temporary_quota(message), P.TEMPORARY_COOLDOWN_MS).otherwise(
        P.RATE_COOLDOWN_MS
    )
    return (
        F.when(is_daily_quota(message), P.DAILY_COOLDOWN_MS)
        .when(is_rate_limited(message), limited)
        .otherwise(0)
        .cast("bigint")
    )


def hold_ms(message: str) -> int:
    """``cooldown_ms`` of one message, for a task that is to stop calling."""
    low = message.lower()
    if any(w in low for w in P.DAILY_WORDS):
        return P.DAILY_COOLDOWN_MS
    if any(w in low for w in P.QUOTA_WORDS):
        temporary = any(w in low for w in P.TEMPORARY_WORDS)
        return P.TEMPORARY_COOLDOWN_MS if temporary else P.RATE_COOLDOWN_MS
    return 0


def mask_key(key: Column) -> Column:
    """P18."""
    shown = F.concat(F.left(key, F.lit(4)), F.lit("•" * 4), F.right(key, F.lit(4)))
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "(trống)")
        .when(F.length(key) <= 8, "•" * 8)
        .otherwise(shown)
    )


def normalize_endpoint(raw: Column) -> Column:
    """P19."""
    e = F.regexp_replace(trim_low(raw), "/+$", "")
    ready = e.endswith("/responses") | e.endswith("/chat/completions")
    return F.when(ready, e).otherwise(F.concat(e, F.lit("/responses")))


def endpoint_candidates(endpoint: Column) -> Column:
    """P20: the endpoint and, for the routed provider, its regional hosts."""
    path = F.substring(endpoint, F.instr(endpoint, ".ai") + 3, F.length(endpoint))
    regional = F.array(
        endpoint,
        F.concat(F.lit("https://us.openrouter.ai"), path),
        F.concat(F.lit("https://eu.openrouter.ai"), path),
    )
    routed = F.contains(endpoint, F.lit("openrouter.ai"))
    return F.when(routed, F.array_distinct(regional)).otherwise(F.array(endpoint))


def provider_of(endpoint: Column) -> Column:
    """Provider by host, a custom one otherwise."""
    name = F.lit(P.CUSTOM_PROVIDER)
    for host, provider, _, _ in reversed(P.PROVIDERS):
        name = F.when(F.contains(F.coalesce(endpoint, F.lit("")), F.lit(host)), provider).otherwise(
            name
        )
    return name


def http_error(code: Column, endpoint: Column, error: Column) -> Column:
    """One line per class of HTTP status."""
    who = (
        F.when(F.contains(endpoint, F.lit("generativelanguage.googleapis.com")), "Gemini")
        .when(F.contains(endpoint, F.lit("openrouter.ai")), "OpenRouter")
        .otherwise("AI provider")
    )
    note = (
        F.when(code.isin(401, 403), ": API key không hợp lệ hoặc không có quyền. ")
        .when(code == 404, ": endpoint hoặc model không tồn tại. ")
        .when(code == 429, ": quota/rate limit. ")
        .when(code >= 500, ": provider đang lỗi/tạm thời không sẵn sàng. ")
        .otherwise(": ")
    )
    return F.concat(who, F.lit(" HTTP "), code.cast("string"), note, error)


def error_detail(body: Column) -> Column:
    """``code X: message [status]`` from an error object, else the body itself."""
    get = lambda f: F.coalesce(F.get_json_object(body, f"$.error.{f}"), F.lit(""))
    code, message, status = get("code"), get("message"), get("status")
    line = F.concat(
        F.when(code != "", F.concat(F.lit("code "), code, F.lit(": "))).otherwise(""),
        message,
        F.when(status != "", F.concat(F.lit(" ["), status, F.lit("]"))).otherwise(""),
    )
    fallback = F.when(
        F.coalesce(body, F.lit("")) == "", "Provider không trả về chi tiết lỗi."
    ).otherwise(body)
    return F.when(line != "", line).otherwise(fallback)


def retry_delay_ms(header: Column, body: Column) -> Column:
    """Retry-After seconds, else the first ``retryDelay`` of the error details;
    between 1 s and 60 s, 5 s when neither is given."""
    details = F.from_json(
        F.get_json_object(body, "$.error.details"), "array<struct<retryDelay:string>>"
    )
    delays = F.filter(details, lambda x: x["retryDelay"].endswith("s"))
    first = F.try_element_at(delays, F.lit(1))["retryDelay"]
    seconds = F.substring(first, F.lit(1), F.length(first) - 1).try_cast("double")

    def clamp(ms: Column) -> Column:
        bounded = F.least(F.lit(60000), F.greatest(F.lit(1000), ms)).cast("bigint")
        return F.when(ms.isNotNull(), bounded)

    from_header = trim_low(header).try_cast("bigint") * 1000
    return F.coalesce(
        clamp(from_header), clamp((seconds * 1000).cast("bigint")), F.lit(5000).cast("bigint")
    )


def backoff_ms(attempt: Column) -> Column:
    return (attempt * 700).cast("bigint")


def is_free_model(model: Column) -> Column:
    """P42."""
    m = F.lower(F.coalesce(model, F.lit("")))
    ok = m.startswith("gemini-") & F.contains(m, F.lit("flash"))
    return ok & ~_any_of(m, P.FREE_MODEL_EXCLUDED)


def is_free_profile(provider: Column, model: Column) -> Column:
    """free pool membership of a configured profile."""
    names = [name for _, name, _, _ in P.PROVIDERS]
    return (
        (provider == P.OFFLINE_PROVIDER)
        | (provider == names[0])
        | ((provider == names[1]) & is_free_model(model))
    )


def catalog_pairs(ids: Column, labels: Column, fallback: Column) -> Column:
    """Two line lists zipped; the fallback when one is blank or lengths differ."""
    a, b = F.split(ids, "\n", -1), F.split(labels, "\n", -1)
    usable = (trim_low(ids) != "") & (trim_low(labels) != "") & (F.size(a) == F.size(b))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("id"), y.alias("label")))
    return F.when(usable, pairs).otherwise(fallback)


def model_status(ready: Column, size: Column, partial: Column) -> Column:
    """P49."""
    mb = F.lit(1024.0 * 1024.0)
    return (
        F.when(ready, F.format_string("%.0f MB", size / mb))
        .when(partial > 0, F.format_string("đã tải %.0f MB", partial / mb))
        .otherwise("chưa tải")
    )


def model_file_problem(size: Column) -> Column:
    """Message for a model file that is too small to be complete, else null."""
    mb = F.floor(size / F.lit(1024 * 1024)).cast("string")
    return F.when(size < P.MODEL_MIN_BYTES, F.concat(F.lit("model file too small: "), mb, F.lit(" MB")))


def content_range_total(header: Column) -> Column:
    """Total size from ``bytes a-b/total``, -1 when unknown."""
    total = trim_low(F.substring_index(header, "/", -1)).try_cast("bigint")
    return F.when(F.contains(header, F.lit("/")), F.coalesce(total, F.lit(-1))).otherwise(
        F.lit(-1)
    ).cast("bigint")
