"""Scalar functions on hand-made rows, boundary by boundary."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import markup as M
from foliospark.functions import predicates as PR
from foliospark.functions import provider as PV
from foliospark.functions import response as R
from foliospark.functions import text as X
from foliospark.operators import validate as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


s = F.col("s")


@pytest.mark.parametrize(
    "attrs, plain, wanted",
    [
        ("", "a", False),
        ("", "12.5 (3)", False),
        (' class="ref"', "A long enough sentence here.", False),
        (' class="ref"\n', "A long enough sentence here.", True),
        (' class="preface"', "A long enough sentence here.", True),
        ("", "MRI", False),
        ("", "Overview", False),
        ("", "Renal", True),
        ("", "Table 129.4", True),
        ("", "Table 12", False),
        ("", "Siêu âm thai bình thường", False),
        ("", "The dose for Việt patients was given twice every single day", True),
        ("", "\U00020000", True),
    ],
)
def test_should_translate(spark, attrs, plain, wanted):
    assert one(spark, PR.should_translate(F.col("a"), s), a=attrs, s=plain) is wanted


@pytest.mark.parametrize(
    "raw, wanted",
    [("```html\n<p>x</p>\n```", "<p>x</p>"), ("  x ", "x"), (None, ""), ("```x```", "x"), ("see <b>x</b> end", "see <b>x</b> end")],
)
def test_clean(spark, raw, wanted):
    assert one(spark, X.clean_fragment(s), s=raw) == wanted


def test_cut_prose(spark):
    assert one(spark, X.clean_fragment(s, cut_prose=True), s="see <b>x</b> end") == "<b>x</b>"


@pytest.mark.parametrize("text, n", [("", 0), ("  ", 0), ("no end", 1), ("A. B! C?", 3), ("v1.2 is out", 1)])
def test_sentences(spark, text, n):
    assert one(spark, X.sentence_count(s), s=text) == n


def test_tokens_and_splits(spark):
    text = "Use 10-20% or 5to6, ratio 3:4, code ABC-1.2; not x12."
    assert one(spark, X.important_tokens(s), s=text) == ["10-20%", "5to6", "3:4", "abc-1.2"]
    assert one(spark, X.split_sentences(s), s=" One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, X.chunk_long_text(s, 10), s="aaaa. bbbb. cccccccccccccc. d") == [
        "aaaa.", "bbbb.", "cccccccccccccc.", "d",
    ]
    assert one(spark, X.normalize_path(s), s="/a/./b//../../../c/x.html") == "c/x.html"
    assert one(spark, X.utf16_length(s), s="a\U0001f600b") == 4


@pytest.mark.parametrize(
    "text", ["plain", "", "<p class='x'>a &amp; b<!-- c --><br/></p>", "a < b > c", "&#xAF;&#12;&bogus", "<i>" * 1200]
)
def test_markup_roundtrip(spark, text):
    restored = M.restore_markup(M.protect_markup(s), M.markup_tokens(s))
    assert one(spark, restored, s=text) == text


@pytest.mark.parametrize(
    "answer, wanted",
    [
        ("__KEEP_MARKUP_001__x__KEEP_MARKUP_000__", "</b>x<b>"),
        ("__KEEP_MARKUP_000__x", None),
        ("__KEEP_MARKUP_000__x__KEEP_MARKUP_001____KEEP_MARKUP_001__", None),
        ("__KEEP_MARKUP_000____KEEP_MARKUP_001__ __KEEP_MARKUP_007__", "<b></b> __KEEP_MARKUP_007__"),
    ],
)
def test_restore(spark, answer, wanted):
    assert one(spark, M.restore_markup(s, F.array(F.lit("<b>"), F.lit("</b>"))), s=answer) == wanted


LONG = "word " * 16  # 79 visible characters
PAIRS = [
    ("<b>x</b>", "", "AI trả về nội dung trống"),
    ("x", "anything", None),
    ("some text", "<br/>", "bản dịch không có nội dung nhìn thấy"),
    (LONG, "short", None),
    (LONG + "ab", "a" * 24, "bản dịch ngắn bất thường so với nội dung nguồn"),
    (LONG + "ab", "a" * 25, None),
    ("A b. C d. E f. G h.", "A. B.", "thiếu câu (nguồn 4 câu, bản dịch 2 câu)"),
    ("A b. C d. E f.", "A. B.", None),
    ("1-2 3-4 5% 6%", "1-2 3-4", "thiếu số liệu/citation quan trọng (2/4 token được giữ lại)"),
    ("1-2 3-4 5% 6%", "1-2 3-4 5%", None),
    ("5% 5% 5% 5%", "5% 5%", "thiếu số liệu/citation quan trọng (2/4 token được giữ lại)"),
    ("Feature", "feature", "heading Feature chưa được dịch"),
    ("Feature", "Đặc điểm", None),
    ("Renal", "gan", "heading Renal chưa được dịch"),
    ("Classic  signs", "Các dấu hiệu", None),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, src string, dst string, want string")
    rows = V.with_reason(df, "src", "dst").orderBy("i").collect()
    assert [r.reason for r in rows] == [p[2] for p in PAIRS]


def test_markers_and_items(spark):
    raw = "x [[[UNIT_0]]] a\\nb [[[unit_2]]]c[[[UNIT_0]]]last[[[UNIT_9]]]no"
    assert one(spark, R.parse_markers(s, F.lit(3)), s=raw) == {2: "c", 0: "last"}
    raw = 'ok [{"id":"0","translation":" a "},{"id":1,"translation":"b"},{"id":"x","translation":"c"},{"id":"2","translation":""}] end'
    assert one(spark, R.parse_items(s, F.lit(3)), s=raw) == {0: "a", 1: "b"}
    got = one(spark, R.prompt_items(s), s='do {x} it {"a":{"b":1},"id":"1","source":"q\\"}"} now\n{"id":2,\n"source":"r"}')
    # no line is one object, so both are found in the whole text
    assert [tuple(r) for r in got] == [("1", 'q"}'), ("2", "r")]
    got = one(spark, R.prompt_items(s), s='x { {"id":2,\n"source":"r{}"} {"id":3} {"source":\n"s","id":"4"')
    assert [tuple(r) for r in got] == [("2", "r{}")]


@pytest.mark.parametrize(
    "body, wanted",
    [
        ('{"choices":[{"message":{"content":"```\\nhi\\n```"}}]}', "hi"),
        ('{"choices":[{"message":{"content":{"text":" hi "}}}]}', "hi"),
        ('{"choices":[{"message":{"content":[{"text":"a"},{"content":"b"}]}}]}', "a\nb"),
        ('{"choices":[{"message":{},"text":"t"}]}', "t"),
        ('{"choices":[{"message":{"reasoning":"r"}}]}', None),
        ('{"choices":[]}', None),
        ("not json", None),
        ('{"choices":[{"message":{"content":"[{\\"id\\":\\"u1\\",\\"translation\\":\\"t\\"}]"}}]}', '[{"id":"u1","translation":"t"}]'),
        ('{"choices":[{"message":{"content":"{\\"id\\":\\"u1\\"}"}}]}', '{"id":"u1"}'),
        ('{"choices":[{"message":{"content":"  "},"text":"t"}]}', "t"),
    ],
)
def test_chat_text(spark, body, wanted):
    assert one(spark, R.chat_text(s), s=body) == wanted


@pytest.mark.parametrize(
    "message, wanted",
    [
        ("HTTP 429", 60_000), ("quota: requests per minute", 900_000), ("Requests per day", 86_400_000),
        ("HTTP 503", 0), (None, 0), ("rpm too high", 0),
    ],
)
def test_cooldown(spark, message, wanted):
    assert one(spark, PV.cooldown_ms(s), s=message) == wanted


def test_endpoints(spark):
    assert one(spark, PV.normalize_endpoint(s), s=" https://a/v1// ") == "https://a/v1/responses"
    assert one(spark, PV.endpoint_candidates(s), s="https://openrouter.ai/api") == [
        "https://openrouter.ai/api", "https://us.openrouter.ai/api", "https://eu.openrouter.ai/api",
    ]
    assert one(spark, PV.retry_delay_ms(F.col("h"), s), h="120", s=None) == 60_000
    assert one(spark, PV.retry_delay_ms(F.col("h"), s), h=None, s='{"error":{"details":[{"retryDelay":"2.5s"}]}}') == 2500
    assert one(spark, PV.error_detail(s), s='{"error":{"code":7,"message":"m","status":"S"}}') == "code 7: m [S]"
    assert one(spark, PV.error_detail(s), s="") == "Provider không trả về chi tiết lỗi."


def test_geometry(spark):
    f = lambda *v: F.array(*[G.f32(x) for x in v])
    assert one(spark, G.unique_floats(f(5, 1, 2, 9), 1.5), s="") == [1.5, 5.0, 9.0]
    assert one(spark, G.boundary_before(f(1, 5, 9), G.f32(8), G.f32(0)), s="") == 9.0
    assert one(spark, G.boundary_after(f(1, 5, 9), G.f32(8.5), G.f32(99)), s="") == 99.0
    assert one(spark, G.overlap_ratio(G.f32(0), G.f32(10), G.f32(5), G.f32(9)), s="") == 1.0
    assert one(spark, G.wrap_lines(s, G.f32(10), G.f32(30)), s="aa bb cc\n\nddddddddd e") == ["aa bb", "cc", "ddddddddd", "e"]
