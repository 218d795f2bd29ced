"""Patterns, word lists, formats and limits.

They decide the results, so they are stated plainly and in one place.
All patterns are java.util.regex as used by Spark SQL.
"""

# --- block markup -----------------------------------------------------------
BLOCK_TAGS = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "th", "td",
    "li", "blockquote", "dt", "dd", "pre", "address",
)
CONTAINER_TAGS = ("div", "section", "article", "aside")

BLOCK = r"(?is)<(" + "|".join(BLOCK_TAGS) + r")\b([^>]*)>(.*?)</\1>"
CONTAINER = r"(?is)<(" + "|".join(CONTAINER_TAGS) + r")\b([^>]*)>(.*?)</\1>"
ANY_BLOCK = r"(?i)<(?:" + "|".join(BLOCK_TAGS + CONTAINER_TAGS) + r")\b"

# comments, tags and character references kept out of the translator's hands
MARKUP = r"(?is)<!--.*?-->|<[^>]+>|&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"
PLACEHOLDER_FORMAT = "__KEEP_MARKUP_%03d__"
PLACEHOLDER = r"__KEEP_MARKUP_(\d{3,})__"

TAG = r"<[^>]+>"
ENTITY = r"&[a-zA-Z#0-9]+;"

# --- words, sentences, tokens -------------------------------------------------
# An explicit Unicode word boundary: the meaning of \b changed between JDKs. ASCII
# comes first in the class, which decides most characters without a category lookup.
WORD_BEFORE = r"(?<![A-Za-z0-9_\p{L}\p{M}\p{N}])"
WORD_AFTER = r"(?![A-Za-z0-9_\p{L}\p{M}\p{N}])"

SENTENCE_END = r"[.!?](?=\s|$)"
SENTENCE_SPLIT = r"(?<=[.!?])\s+"
CHUNK_SPLIT = r"(?<=[.!?;:])\s+"
ENGLISH_WORD = r"(?=[A-Za-z])" + WORD_BEFORE + r"[A-Za-z]{3,}+" + WORD_AFTER
VIETNAMESE_WORD = "[À-ỹĐđ]{2,}"
VIETNAMESE_MARK = "[ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠàáâãèéêìíòóôõùúăđĩũơƯưẠ-ỹ]"
IMPORTANT_TOKEN = (
    r"(?i)(?<![A-Za-z0-9])(?:\d+(?:[.,]\d+)?(?:–|-|to)\d+(?:[.,]\d+)?%?"
    r"|\d+(?:[.,]\d+)?%|\d+:[0-9]+|[A-Z]{2,}\d*(?:[.-]\d+)+)(?![A-Za-z0-9])"
)

# --- translatability ------------------------------------------------------------
DENIED_ATTRIBUTE_WORDS = (
    "ref", "ref1", "reflist", "references", "bibliography", "bib", "doi", "url",
    "tsource", "tsource1", "figcredit", "fignum",
)
SHORT_HEADINGS = (
    "definition", "feature", "renal", "seizure", "prenatal", "classic signs",
    "key points", "references",
)
NUMBERED_TABLE = r"^table\s+129\.[0-9]+$"

# --- validation: heading -> accepted renderings, exact match or contained ------------
HEADING_EXACT = {"feature": ("đặc điểm", "đặc trưng")}
HEADING_CONTAINS = {
    "renal": "thận",
    "seizure": "co giật",
    "prenatal": "trước sinh",
    "definition": "định nghĩa",
    "classic signs": "dấu hiệu",
}
HEADING_LABEL = {
    "feature": "Feature",
    "renal": "Renal",
    "seizure": "Seizure",
    "prenatal": "Prenatal",
    "definition": "Definition",
    "classic signs": "Classic Signs",
}
REASON_BLANK = "AI trả về nội dung trống"
REASON_INVISIBLE = "bản dịch không có nội dung nhìn thấy"
REASON_SHORT = "bản dịch ngắn bất thường so với nội dung nguồn"
REASON_SENTENCES = "thiếu câu (nguồn %d câu, bản dịch %d câu)"
REASON_TOKENS = "thiếu số liệu/citation quan trọng (%d/%d token được giữ lại)"
REASON_HEADING = "heading %s chưa được dịch"

# --- batching ---------------------------------------------------------------------
BATCH_UNITS = 8
BATCH_CHARS = 12000
UNIT_OVERHEAD = 180
CHUNK_CHARS = 1400
GLOSSARY_TOP = 40

# --- provider messages --------------------------------------------------------------
QUOTA_WORDS = ("http 429", "quota", "rate limit", "free-models-per-day", "requests per day")
DAILY_WORDS = (
    "free-models-per-day", "free model requests per day", "requests per day", "add 10 credits",
)
TEMPORARY_WORDS = ("requests per minute", "tokens per minute", "rpm", "tpm", "retry-after")
TRANSIENT_WORDS = (
    "connection reset", "connection aborted", "software caused connection abort",
    "broken pipe", "stream reset", "refused", "timed out", "timeout",
)
DAILY_COOLDOWN_MS = 24 * 60 * 60 * 1000
TEMPORARY_COOLDOWN_MS = 15 * 60 * 1000
RATE_COOLDOWN_MS = 60 * 1000

# host substring, provider name, default endpoint, default model
PROVIDERS = (
    ("openrouter.ai", "OpenRouter — FREE / PAID",
     "https://openrouter.ai/api/v1/chat/completions", "inclusionai/ling-3.0-flash-sante:free"),
    ("generativelanguage.googleapis.com", "Google Gemini — FREE / PAID",
     "https://generativelanguage.googleapis.com/v1beta/openai/chat/completions",
     "gemini-3.5-flash-lite"),
    ("api.openai.com", "OpenAI — PAID", "https://api.openai.com/v1/responses", "gpt-5.6-luna"),
    ("api.deepseek.com", "DeepSeek — PAID",
     "https://api.deepseek.com/v1/chat/completions", "deepseek-flash"),
    ("api.mistral.ai", "Mistral — PAID",
     "https://api.mistral.ai/v1/chat/completions", "mistral-small-latest"),
)
CUSTOM_PROVIDER = "Custom OpenAI-compatible"
OFFLINE_PROVIDER = "Offline NLLB-600M"
MODEL_MIN_BYTES = 450 * 1024 * 1024
OFFLINE_SCHEME = "offline://nllb"
MODEL_EXCLUDED = (
    "-tts", "-live", "image", "transcribe", "embedding", "robotics", "computer-use",
    "deep-research", "omni",
)
FREE_MODEL_EXCLUDED = ("pro", "image", "live", "tts", "embedding")

# --- offline engine output ------------------------------------------------------------
ENGINE_LOG_PREFIXES = ("main:", "load:", "decode:", "llama_", "system_info", "model")

# --- page layout ------------------------------------------------------------------------
UNIT_MARKER = r"(?i)\[\[\[UNIT_(\d+)\]\]\]\s*"
UNIT_MARKER_FORMAT = "[[[UNIT_%d]]]\n"
LAYOUT_VERSION = "9"
UNPRINTABLE = (
    r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x{FFFD}"
    r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
)
FOOTER_WORDS = (
    "j obstet gynaecol can", "https://doi.org/", "© 2018", "published by elsevier",
    "all rights reserved",
)
GRAPHICS_OPERATORS = (
    "q", "Q", "cm", "w", "J", "j", "M", "d", "ri", "i", "gs",
    "CS", "cs", "SC", "SCN", "sc", "scn", "G", "g", "RG", "rg", "K", "k",
    "m", "l", "c", "v", "y", "h", "re", "S", "s", "F", "f", "f*", "B", "B*",
    "b", "b*", "n", "W", "W*", "Do", "sh",
)
