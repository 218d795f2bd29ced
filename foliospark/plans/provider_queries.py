"""Provider routing over the event table as a call log, and response parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import provider as PV
from ..functions import response as R
from ..functions import text as X
from ..operators import router as RT
from . import sqltext as S
from .registry import query, table

MESSAGE = (
    "CASE WHEN event_type = 'error' THEN CASE event_id % 7"
    " WHEN 0 THEN 'Provider HTTP 429: quota exceeded, 20 requests per minute'"
    " WHEN 1 THEN 'HTTP 429 rate limit' WHEN 2 THEN 'Connection reset by peer'"
    " WHEN 3 THEN 'Free model requests per day used; add 10 credits'"
    " WHEN 4 THEN 'read timed out' WHEN 5 THEN 'Retry-After: quota' ELSE 'HTTP 503' END END"
)
ENDPOINT = (
    "CASE user_id % 7 WHEN 0 THEN ' https://openrouter.ai/api/v1/chat/completions '"
    " WHEN 1 THEN 'https://generativelanguage.googleapis.com/v1beta/openai//' WHEN 2 THEN 'https://api.openai.com/v1'"
    " WHEN 3 THEN 'https://api.deepseek.com/v1/responses/' WHEN 4 THEN 'https://api.mistral.ai/v1'"
    " WHEN 5 THEN 'https://openrouter.ai/api/v1/' ELSE 'http://host' || user_id || '/v1' END"
)

_SQL_CLASS = """CASE WHEN contains(m, 'free-models-per-day') OR contains(m, 'free model requests per day')
        OR contains(m, 'requests per day') OR contains(m, 'add 10 credits')"""
_SQL_LIMITED = """contains(m, 'http 429') OR contains(m, 'quota') OR contains(m, 'rate limit')
        OR contains(m, 'free-models-per-day') OR contains(m, 'requests per day')"""
_SQL_TEMP = """contains(m, 'requests per minute') OR contains(m, 'tokens per minute') OR contains(m, 'rpm')
        OR contains(m, 'tpm') OR contains(m, 'retry-after')"""
_SQL_COOLDOWN = f"""({_SQL_CLASS} THEN 86400000 WHEN {_SQL_LIMITED} THEN
        CASE WHEN {_SQL_TEMP} THEN 900000 ELSE 60000 END ELSE 0 END)::BIGINT"""


@query(
    "failover_classify", "P21,T4",
    f"""SELECT event_id, {_SQL_LIMITED} AS rate_limited, ({_SQL_CLASS} THEN true ELSE false END) AS daily, {_SQL_TEMP} AS temporary,
               regexp_matches(m, 'connection reset|connection aborted|software caused connection abort|broken pipe|stream reset|refused|timed out|timeout') AS transient,
               {_SQL_COOLDOWN} AS cooldown_ms
        FROM (SELECT event_id, lower(coalesce({MESSAGE}, '')) AS m FROM events)""",
)
def failover_classify(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("message")
    calls = table(spark, d, "events").select("event_id", F.expr(MESSAGE).alias("message"))
    return calls.select(
        "event_id",
        PV.is_rate_limited(m).alias("rate_limited"),
        PV.is_daily_quota(m).alias("daily"),
        PV.is_temporary_quota(m).alias("temporary"),
        PV.is_transient(m).alias("transient"),
        PV.cooldown_ms(m).alias("cooldown_ms"),
    )


def call_log(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(
        "event_id", "user_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.expr(MESSAGE).alias("message"),
    )
    return calls.withColumn("cooldown", PV.cooldown_ms(F.col("message"))).drop("message")


@query(
    "cooldown_replay", "T4,F5,C14",
    f"""WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_ms(ts) AS ts_ms, {_SQL_COOLDOWN} AS cd
                             FROM (SELECT *, lower(coalesce({MESSAGE}, '')) AS m FROM events)),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM c),
        w AS (SELECT user_id, rn, event_id, false AS skipped, CASE WHEN cd > 0 THEN ts_ms + cd ELSE 0 END AS until FROM n WHERE rn = 1
              UNION ALL
              SELECT n.user_id, n.rn, n.event_id, w.until > n.ts_ms,
                     CASE WHEN w.until > n.ts_ms THEN w.until WHEN n.cd > 0 THEN n.ts_ms + n.cd ELSE w.until END
              FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
        SELECT user_id, event_id, skipped FROM w""",
)
def cooldown_replay(spark: SparkSession, d: str) -> DataFrame:
    replayed = RT.replay(call_log(spark, d), "user_id", "ts_ms", "event_id", "cooldown")
    return replayed.select("user_id", "event_id", "skipped")


#: What each of three providers would say to a call; null where it answers.
_STEPS = (7, 11, 13)
OUTCOMES = tuple(
    f"CASE (event_id * {n} + {k}) % 9 WHEN 0 THEN 'HTTP 429 rate limit'"
    " WHEN 1 THEN 'Provider HTTP 429: quota exceeded, 20 requests per minute' WHEN 2 THEN 'Connection reset by peer'"
    " WHEN 3 THEN CASE WHEN event_type = 'error' THEN 'Free model requests per day used; add 10 credits' END END"
    for k, n in enumerate(_STEPS)
)
_COSTS = ", ".join(
    f"CASE WHEN m{k} IS NOT NULL THEN {_SQL_COOLDOWN.replace('(m, ', f'(lower(m{k}), ')} END AS c{k}"
    for k in range(len(OUTCOMES))
)


@query(
    "route_calls", "C14,F5,T4",
    f"""WITH RECURSIVE o AS (
          SELECT event_id, CASE WHEN user_id % 3 = 0 THEN user_id % 40 ELSE -1 END AS account, epoch_us(ts) // 1000 AS t,
            {", ".join(f"{o} AS m{k}" for k, o in enumerate(OUTCOMES))} FROM events),
        c AS MATERIALIZED (SELECT account, event_id, t, {_COSTS},
          row_number() OVER (PARTITION BY account ORDER BY t, event_id) AS n FROM o),
        r AS (
          SELECT DISTINCT account, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS h0, 0::BIGINT AS h1, 0::BIGINT AS h2,
            NULL::INTEGER AS served, 0 AS failed, 0 AS held FROM c
          UNION ALL
          SELECT account, n, event_id, h0, h1, h2, served, failed, held FROM (
            SELECT c.account, c.n, c.event_id, r.h0 <= c.t AS a0, a0 AND c.c0 IS NULL AS s0,
              NOT s0 AND r.h1 <= c.t AS a1, a1 AND c.c1 IS NULL AS s1,
              NOT s0 AND NOT s1 AND r.h2 <= c.t AS a2, a2 AND c.c2 IS NULL AS s2,
              CASE WHEN a0 AND c.c0 > 0 THEN c.t + c.c0 ELSE r.h0 END AS h0,
              CASE WHEN a1 AND c.c1 > 0 THEN c.t + c.c1 ELSE r.h1 END AS h1,
              CASE WHEN a2 AND c.c2 > 0 THEN c.t + c.c2 ELSE r.h2 END AS h2,
              CASE WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 END::INTEGER AS served,
              (a0 AND NOT s0)::INTEGER + (a1 AND NOT s1)::INTEGER + (a2 AND NOT s2)::INTEGER AS failed,
              (NOT a0)::INTEGER + (NOT s0 AND NOT a1)::INTEGER + (NOT s0 AND NOT s1 AND NOT a2)::INTEGER AS held
            FROM r JOIN c ON c.account = r.account AND c.n = r.n + 1))
        SELECT account, event_id, served, failed, held FROM r WHERE event_id IS NOT NULL""",
)
def route_calls(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of all calls share one account, and so its holds."""
    calls = table(spark, d, "events").select(
        "event_id", F.expr("CASE WHEN user_id % 3 = 0 THEN user_id % 40 ELSE -1 END").alias("account"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        *[F.expr(o).alias(f"m{k}") for k, o in enumerate(OUTCOMES)],
    )
    costs = {f"c{k}": F.when(F.col(f"m{k}").isNotNull(), PV.cooldown_ms(F.col(f"m{k}"))) for k in range(len(OUTCOMES))}
    calls = calls.select("account", "event_id", "t", *[c.alias(n) for n, c in costs.items()])
    routed = RT.route(calls, "account", "t", "event_id", list(costs))
    return routed.select("account", "event_id", "served", "failed", "held")


CODE = "CASE event_id % 6 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 403 ELSE 418 END"


@query(
    "http_error_format", "P22,P23",
    f"""SELECT event_id, CASE WHEN contains(e, 'generativelanguage.googleapis.com') THEN 'Gemini' WHEN contains(e, 'openrouter.ai') THEN 'OpenRouter' ELSE 'AI provider' END
               || ' HTTP ' || code || CASE WHEN code IN (401, 403) THEN ': API key không hợp lệ hoặc không có quyền. '
               WHEN code = 404 THEN ': endpoint hoặc model không tồn tại. ' WHEN code = 429 THEN ': quota/rate limit. '
               WHEN code >= 500 THEN ': provider đang lỗi/tạm thời không sẵn sàng. ' ELSE ': ' END ||
               CASE event_id % 3 WHEN 0 THEN 'code ' || code || ': bad ' || event_type WHEN 1 THEN 'm [X' || user_id || ']' ELSE props END AS line
        FROM (SELECT *, {ENDPOINT} AS e, {CODE} AS code FROM events)""",
)
def http_error_format(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr(
        "CASE event_id % 3 WHEN 0 THEN '{\"error\":{\"code\":' || code || ',\"message\":\"bad ' || event_type || '\"}}'"
        " WHEN 1 THEN '{\"error\":{\"message\":\"m\",\"status\":\"X' || user_id || '\"}}' ELSE props END"
    )
    calls = table(spark, d, "events").withColumns(
        {"endpoint": F.expr(ENDPOINT), "code": F.expr(CODE)}
    )
    line = PV.http_error(F.col("code"), F.col("endpoint"), PV.error_detail(F.col("body")))
    return calls.withColumn("body", body).select("event_id", line.alias("line"))


@query(
    "retry_delay", "P24",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(60000, greatest(1000, user_id * 1000))
               WHEN 1 THEN least(60000, greatest(1000, (value * 1000)::DOUBLE::BIGINT)) ELSE 5000 END::BIGINT AS delay_ms,
               (700 * (1 + event_id % 3))::BIGINT AS backoff_ms
        FROM (SELECT event_id, user_id, trunc(value)::BIGINT AS value FROM events)""",
)
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    header = F.expr("CASE event_id % 4 WHEN 0 THEN ' ' || user_id || ' ' WHEN 2 THEN 'soon' END")
    body = F.expr(
        "CASE event_id % 4 WHEN 1 THEN '{\"error\":{\"details\":[{\"a\":1},{\"retryDelay\":\"' || cast(value as bigint)"
        " || 's\"}]}}' ELSE 'gateway' END"
    )
    calls = table(spark, d, "events").select("event_id", header.alias("header"), body.alias("body"))
    return calls.select(
        "event_id",
        PV.retry_delay_ms(F.col("header"), F.col("body")).alias("delay_ms"),
        PV.backoff_ms(1 + F.col("event_id") % 3).alias("backoff_ms"),
    )


@query(
    "endpoint_normalize", "P19,P20,P47,S15",
    rf"""WITH e AS (SELECT event_id, regexp_replace({S.trim_low('e')}, '/+$', '') AS e FROM (SELECT event_id, {ENDPOINT} AS e FROM events)),
        n AS (SELECT event_id, CASE WHEN ends_with(e, '/responses') OR ends_with(e, '/chat/completions') THEN e ELSE e || '/responses' END AS endpoint FROM e)
        SELECT event_id, endpoint,
               CASE WHEN contains(endpoint, 'openrouter.ai') THEN 'OpenRouter — FREE / PAID' WHEN contains(endpoint, 'generativelanguage.googleapis.com') THEN 'Google Gemini — FREE / PAID'
                    WHEN contains(endpoint, 'api.openai.com') THEN 'OpenAI — PAID' WHEN contains(endpoint, 'api.deepseek.com') THEN 'DeepSeek — PAID'
                    WHEN contains(endpoint, 'api.mistral.ai') THEN 'Mistral — PAID' ELSE 'Custom OpenAI-compatible' END AS provider,
               CASE WHEN contains(endpoint, 'openrouter.ai') THEN endpoint || '|' || replace(endpoint, 'https://', 'https://us.') || '|' || replace(endpoint, 'https://', 'https://eu.')
                    ELSE endpoint END AS candidates
        FROM n""",
)
def endpoint_normalize(spark: SparkSession, d: str) -> DataFrame:
    endpoints = table(spark, d, "events").select(
        "event_id", PV.normalize_endpoint(F.expr(ENDPOINT)).alias("endpoint")
    )
    return endpoints.select(
        "event_id", "endpoint", PV.provider_of(F.col("endpoint")).alias("provider"),
        F.array_join(PV.endpoint_candidates(F.col("endpoint")), "|").alias("candidates"),
    )


PROFILE_NAME = (
    "CASE user_id % 5 WHEN 0 THEN 'OpenRouter — FREE / PAID' WHEN 1 THEN 'Google Gemini — FREE / PAID'"
    " WHEN 2 THEN 'OpenAI — PAID' WHEN 3 THEN 'Offline NLLB-600M' ELSE 'Custom OpenAI-compatible' END"
)
PROFILE_MODEL = (
    "CASE WHEN user_id % 5 = 1 THEN CASE event_id % 4 WHEN 0 THEN 'gemini-3.5-flash-lite' WHEN 1 THEN 'gemini-3.5-pro'"
    " WHEN 2 THEN 'Gemini-2.5-FLASH' ELSE 'gemini-flash-image' END WHEN event_type = 'view' THEN ' ' ELSE event_type END"
)
PROFILE_ENDPOINT = "CASE user_id % 5 WHEN 3 THEN 'offline://nllb' ELSE 'https://h' || user_id END"


@query(
    "provider_order", "C17,U4,F4,F6,P42,D9",
    f"""WITH p AS (SELECT event_id // 100 AS book, {PROFILE_NAME} AS name, {PROFILE_MODEL} AS model, {PROFILE_ENDPOINT} AS endpoint,
                   CASE WHEN event_type = 'signup' THEN '' ELSE 'k' || (event_id % 2) END AS key_ref, event_id FROM events),
        e AS (SELECT * FROM p WHERE trim(model) <> '' AND (starts_with(endpoint, 'offline://nllb') OR key_ref <> '')
              AND (name IN ('Offline NLLB-600M', 'OpenRouter — FREE / PAID') OR (name = 'Google Gemini — FREE / PAID'
                   AND starts_with(lower(model), 'gemini-') AND contains(lower(model), 'flash')
                   AND NOT regexp_matches(lower(model), 'pro|image|live|tts|embedding')))),
        g AS (SELECT book, name, model, endpoint, min(event_id) AS rank FROM e GROUP BY book, name, model, key_ref, endpoint)
        SELECT book, name, model, endpoint, CASE WHEN starts_with(endpoint, 'offline://nllb') THEN 0 ELSE 1 END AS tier, rank::BIGINT AS rank FROM g""",
)
def provider_order(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "events").select(
        F.expr("event_id div 100").alias("book"), F.expr(PROFILE_NAME).alias("name"),
        F.expr(PROFILE_MODEL).alias("model"), F.expr(PROFILE_ENDPOINT).alias("endpoint"),
        F.expr("CASE WHEN event_type = 'signup' THEN '' ELSE 'k' || (event_id % 2) END").alias("api_key_ref"),
        F.col("event_id").alias("rank"),
    )
    return RT.provider_order(profiles, "book", free_only=True, allow_paid=False)


@query(
    "mask_key", "P18,P49,S18",
    """SELECT c_custkey, CASE WHEN k = '' THEN '(trống)' WHEN length(k) <= 8 THEN '••••••••' ELSE left(k, 4) || '••••' || right(k, 4) END AS masked,
              CASE WHEN c_custkey % 3 = 0 THEN 'ready' WHEN c_acctbal > 0 THEN 'đã tải' ELSE 'chưa tải' END AS status,
              CASE WHEN c_custkey % 3 = 2 THEN -1 ELSE c_custkey END::BIGINT AS total_bytes
       FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN left(c_name, 8) ELSE c_name END AS k FROM customer)""",
)
def mask_key(spark: SparkSession, d: str) -> DataFrame:
    key = F.expr(
        "CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN left(c_name, 8) ELSE c_name END"
    )
    status = PV.model_status(
        F.col("c_custkey") % 3 == 0, F.lit(5e8), F.floor(F.col("c_acctbal") * 1000)
    )
    header = F.expr("CASE WHEN c_custkey % 3 = 2 THEN 'bytes */*' ELSE 'bytes 0-1/ ' || c_custkey END")
    word = F.when(status == "477 MB", "ready").otherwise(F.regexp_replace(status, r" -?\d+ MB$", ""))
    return table(spark, d, "customer").select(
        "c_custkey", PV.mask_key(key).alias("masked"), word.alias("status"),
        PV.content_range_total(header).alias("total_bytes"),
    )


@query(
    "catalog_pairs", "P48",
    """WITH c AS (SELECT p_partkey, p_name, p_type FROM part)
       SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '=' || p_type || ';' || p_partkey || '=L'
              ELSE 'gemini-3.5-flash-lite=Default' END AS pairs FROM c""",
)
def catalog_pairs(spark: SparkSession, d: str) -> DataFrame:
    ids = F.expr("CASE WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_name || '\\n' || p_partkey END")
    labels = F.expr("CASE WHEN p_partkey % 3 = 2 THEN p_type ELSE p_type || '\\nL' END")
    fallback = F.array(
        F.struct(F.lit("gemini-3.5-flash-lite").alias("id"), F.lit("Default").alias("label"))
    )
    pairs = F.transform(
        PV.catalog_pairs(ids, labels, fallback), lambda x: F.concat(x["id"], F.lit("="), x["label"])
    )
    return table(spark, d, "part").select("p_partkey", F.array_join(pairs, ";").alias("pairs"))


@query(
    "model_catalog", "S16",
    """WITH m AS (SELECT event_id // 50 AS book, 'gemini-' || user_id || CASE event_type WHEN 'click' THEN '-tts' WHEN 'error' THEN '-preview' ELSE '' END AS id,
                  event_type, event_id FROM events WHERE user_id % 9 <> 0)
       SELECT book, event_id, id, 'M ' || id || CASE WHEN event_type IN ('error', 'signup') THEN ' — PREVIEW' ELSE '' END AS label
       FROM m WHERE event_type NOT IN ('click', 'view')""",
)
def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    """One catalog body per event: an entry, and one without the needed method."""
    name = F.expr(
        "CASE WHEN user_id % 9 = 0 THEN 'models/embed-' ELSE 'models/gemini-' END || user_id || "
        "CASE event_type WHEN 'click' THEN '-tts' WHEN 'error' THEN '-preview' ELSE '' END"
    )
    entry = F.struct(
        name.alias("name"),
        F.concat(F.lit("M "), F.regexp_replace(name, "^models/", "")).alias("displayName"),
        F.when(F.col("event_type") == "signup", "a Preview").otherwise("text").alias("description"),
        F.when(F.col("event_type") == "view", F.array(F.lit("countTokens")))
        .otherwise(F.array(F.lit("countTokens"), F.lit("GenerateContent")))
        .alias("supportedGenerationMethods"),
    )
    body = F.to_json(F.struct(F.array(entry).alias("models")))
    bodies = table(spark, d, "events").select(
        F.expr("event_id div 50").alias("book"), "event_id", body.alias("body")
    )
    found = bodies.select(
        "book", "event_id", F.explode_outer(R.model_catalog(F.col("body"))).alias("m")
    )
    return found.filter("m IS NOT NULL").select("book", "event_id", "m.id", "m.label")


_TRIM_TEXT = S.trim_low("text")


@query(
    "chat_text_extract", "P25,P26,P3",
    f"""SELECT conv_id, turn, sha256(CASE turn % 6 WHEN 0 THEN {_TRIM_TEXT} WHEN 1 THEN {_TRIM_TEXT} WHEN 2 THEN {_TRIM_TEXT} || chr(10) || 'second'
                 WHEN 4 THEN '[{{"id":"' || turn || '"}}]' WHEN 5 THEN '{{"id":"' || turn || '"}}' END) AS chat_hash,
               turn % 6 = 3 AS reasoning_only,
               sha256(CASE turn % 3 WHEN 0 THEN {_TRIM_TEXT} WHEN 1 THEN {_TRIM_TEXT} || chr(10) || 'tail' END) AS responses_hash
        FROM conversations""",
)
def chat_text_extract(spark: SparkSession, d: str) -> DataFrame:
    text, turn = X.trim_low(F.col("text")), F.col("turn")

    def message(content: Column) -> Column:
        return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))

    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    thinking = F.struct(F.array(F.struct(F.struct(text.alias("reasoning")).alias("message"))).alias("choices"))
    chat = (
        F.when(turn % 6 == 0, message(text))
        .when(turn % 6 == 1, message(part(text)))
        .when(turn % 6 == 2, message(F.array(part(text), part(F.lit("")), part(F.lit(" second ")))))
        # a string that is JSON itself, as every batch answer is
        .when(turn % 6 == 4, message(F.concat(F.lit('[{"id":"'), turn, F.lit('"}]'))))
        .when(turn % 6 == 5, message(F.concat(F.lit('{"id":"'), turn, F.lit('"}'))))
        .otherwise(F.to_json(thinking))
    )
    output = F.struct(
        F.array(
            F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("array<struct<text:string>>").alias("content")),
            F.struct(F.lit("message").alias("type"), F.array(F.struct(text.alias("text")), F.struct(F.lit("tail").alias("text"))).alias("content")),
        ).alias("output")
    )
    responses = (
        F.when(turn % 3 == 0, F.to_json(F.struct(text.alias("output_text"))))
        .when(turn % 3 == 1, F.to_json(output))
        .otherwise('{"output":[]}')
    )
    bodies = table(spark, d, "conversations").select(
        "conv_id", "turn", chat.alias("chat"), responses.alias("resp")
    )
    return bodies.select(
        "conv_id", "turn",
        X.content_hash(R.chat_text(F.col("chat"))).alias("chat_hash"),
        R.reasoning_only(F.col("chat")).alias("reasoning_only"),
        X.content_hash(F.when(turn % 3 < 2, R.responses_text(F.col("resp")))).alias("responses_hash"),
    )


@query(
    "unit_marker_parse", "P30,P31",
    rf"""WITH s AS (SELECT conv_id, turn, {S.split_sentences('text')} AS ss FROM conversations),
        x AS (SELECT conv_id, turn, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS txt FROM s)
        SELECT conv_id, turn, (i % 5)::INTEGER AS unit, sha256(arg_max(txt, i)) AS text_hash
        FROM x WHERE i % 5 < 4 GROUP BY conv_id, turn, i % 5""",
)
def unit_marker_parse(spark: SparkSession, d: str) -> DataFrame:
    """Sentences behind markers 0..4 over and over; number 4 is out of range."""
    marked = F.transform(
        X.split_sentences(F.col("text")),
        lambda s, i: F.concat(F.format_string("[[[unit_%d]]]\\n", i % 5), s),
    )
    raw = F.concat(F.lit("Sure:\n"), F.array_join(marked, "\n"))
    answers = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    units = answers.select(
        "conv_id", "turn",
        F.explode_outer(R.parse_markers(F.col("raw"), F.lit(4))).alias("unit", "txt"),
    )
    return units.filter("unit IS NOT NULL").select(
        "conv_id", "turn", "unit", X.content_hash(F.col("txt")).alias("text_hash")
    )


@query(
    "json_unit_parse", "P32,P33",
    rf"""WITH s AS (SELECT conv_id, turn, {S.split_sentences('text')} AS ss FROM conversations),
        x AS (SELECT conv_id, turn, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS txt FROM s)
        SELECT conv_id, turn, i::INTEGER AS unit, sha256(txt) AS text_hash
        FROM x WHERE i % 8 NOT IN (3, 7)""",
)
def json_unit_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth id is no number, another eighth is out of range."""
    sentences = X.split_sentences(F.col("text"))
    items = F.transform(
        sentences,
        lambda s, i: F.struct(
            F.when(i % 8 == 3, F.lit("x")).when(i % 8 == 7, (i + 1_000_000).cast("string"))
            .otherwise(i.cast("string")).alias("id"),
            s.alias("translation"),
        ),
    )
    raw = F.concat(F.lit("Here:\n"), F.to_json(items), F.lit("\nDone."))
    answers = table(spark, d, "conversations").select(
        "conv_id", "turn", raw.alias("raw"), F.size(sentences).alias("n")
    )
    units = answers.select(
        "conv_id", "turn", F.explode_outer(R.parse_items(F.col("raw"), F.col("n"))).alias("unit", "txt")
    )
    return units.filter("unit IS NOT NULL").select(
        "conv_id", "turn", "unit", X.content_hash(F.col("txt")).alias("text_hash")
    )


@query(
    "prompt_items", "P33,C15",
    """SELECT conv_id, turn, 'u' || turn AS id, sha256(text) AS source_hash FROM conversations""",
)
def prompt_items(spark: SparkSession, d: str) -> DataFrame:
    """Even turns carry one object per line, odd ones an object spread over lines."""
    item = F.struct(F.concat(F.lit("u"), F.col("turn")).alias("id"), F.col("text").alias("source"))
    spread_out = F.replace(F.to_json(item), F.lit('","source"'), F.lit('",\n"source"'))
    body = F.when(F.col("turn") % 2 == 0, F.to_json(item)).otherwise(spread_out)
    prompt = F.concat(F.lit("Translate {all} of it.\n"), body, F.lit("\nthanks"))
    prompts = table(spark, d, "conversations").select("conv_id", "turn", prompt.alias("prompt"))
    items = prompts.select("conv_id", "turn", R.prompt_items(F.col("prompt")).alias("items"))
    return items.select("conv_id", "turn", F.explode_outer("items").alias("x")).select(
        "conv_id", "turn", "x.id", X.content_hash(F.col("x.source")).alias("source_hash")
    )


_NAMES = [name for _, name, _, _ in P.PROVIDERS] + [P.CUSTOM_PROVIDER]


def _name_sql(number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))
    return f"CASE {number} {cases} END"


_DEFAULTS = ", ".join(f"('{name}', '{endpoint}', '{model}')" for _, name, endpoint, model in P.PROVIDERS)


@query(
    "profile_lookup", "J16",
    f"""WITH s AS (SELECT s_suppkey AS owner, {_name_sql("s_suppkey % 6")} AS provider,
               CASE WHEN s_suppkey % 4 > 0 THEN 'https://host' || s_suppkey || '/v1' END AS endpoint,
               CASE WHEN s_suppkey % 3 > 0 THEN 'model-' || s_nationkey END AS model, 'key-' || s_suppkey AS api_key_ref FROM supplier),
        d(provider, endpoint, model) AS (VALUES {_DEFAULTS}),
        c AS (SELECT event_id, user_id AS owner, {_name_sql("event_id % 6")} AS provider FROM events)
        SELECT c.event_id, c.provider, coalesce(s.endpoint, d.endpoint) AS endpoint, coalesce(s.model, d.model) AS model,
               coalesce(s.api_key_ref, '') AS api_key_ref
        FROM c LEFT JOIN s ON s.owner = c.owner AND s.provider = c.provider LEFT JOIN d ON d.provider = c.provider""",
)
def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The profile that each call of the log would use; a third of the saved models and a
    quarter of the endpoints are blank."""
    key = F.col("s_suppkey")
    saved = table(spark, d, "supplier").select(
        key.alias("owner"), F.expr(_name_sql("s_suppkey % 6")).alias("provider"),
        F.when(key % 4 > 0, F.concat(F.lit(" https://host"), key, F.lit("/v1"))).otherwise(" ").alias("endpoint"),
        F.when(key % 3 > 0, F.concat(F.lit("model-"), "s_nationkey")).alias("model"),
        F.concat(F.lit("key-"), key).alias("api_key_ref"),
    )
    slots = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("owner"), F.expr(_name_sql("event_id % 6")).alias("provider")
    )
    return RT.with_profile(slots, saved, "owner").drop("owner")
