"""Archives, glossary CSV, saved state and logs on small fixtures."""

import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.operators import glossary as G
from foliospark.operators import state as ST
from foliospark.operators import units as U
from foliospark.operators.closure import reachable
from foliospark.sources import archive as A
from foliospark.sources import glossary_csv, logs, state
from foliospark.sources.layout import read_marks

CONTAINER = (
    '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
)


def book(path, mimetype="application/epub+zip", images=81):
    """88 entries, one content file with 151 p, 10 figure, 16 img, 5 table; 3 style sheets."""
    body = (
        "".join(f"<p>Paragraph number {i} has some text.</p>" for i in range(151))
        + "<figure></figure>" * 10 + '<img src="a.png"/>' * 16 + "<table></table>" * 5
    )
    html = f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'
    items = ['<item href="../OEBPS/Text/c1.xhtml" media-type="application/xhtml+xml"/>']
    items += [f'<item href="s{i}.css" media-type="text/css"/>' for i in range(3)]
    items += [f'<item href="img/{i}.png" media-type="image/png"/>' for i in range(images)]
    opf = (
        '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"<dc:title> A Book </dc:title></metadata><manifest>{''.join(items)}</manifest></package>"
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if mimetype is not None:
            z.writestr(zipfile.ZipInfo("mimetype", (2020, 1, 2, 3, 4, 6)), mimetype)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/Text/c1.xhtml", html)
        for i in range(3):
            z.writestr(f"OEBPS/s{i}.css", "p{}")
        for i in range(images):
            z.writestr(f"OEBPS/img/{i}.png", b"\x89PNG")


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shelf")
    book(folder / "good.epub")
    book(folder / "bare.epub", mimetype=None, images=1)
    book(folder / "odd.epub", mimetype="text/plain", images=1)
    (folder / "doc.pdf").write_bytes(b"%PDF-1.7 rest")
    (folder / "note.epub").write_bytes(b"hello")
    return folder


def test_archive_profile(spark, shelf):
    files = A.read_files(spark, str(shelf))
    unpacked = A.entries(files)
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in A.checked(files, unpacked).collect()}
    assert problems == {
        "good.epub": None, "doc.pdf": None, "bare.epub": "mimetype is missing",
        "odd.epub": "mimetype is not valid", "note.epub": "not a PDF or EPUB file",
    }
    p = A.book_profile(unpacked).filter(F.col("path").endswith("good.epub")).first()
    assert (p.title, p.total_files, p.xhtml_files, p.css_files, p.image_files) == ("A Book", 88, 1, 3, 81)
    assert (p.p_count, p.figure_count, p.img_count, p.table_count) == (151, 10, 16, 5)


def test_damaged_archives_are_reported_whole(spark, shelf, tmp_path):
    data = (shelf / "good.epub").read_bytes()
    at = data.index(b"OEBPS/content.opf") + len("OEBPS/content.opf") + 20
    for name, blob in (("bad.epub", data[:at] + b"\0" * 40 + data[at + 40:]), ("cut.epub", data[:-200])):
        (tmp_path / name).write_bytes(blob)
    (tmp_path / "fine.epub").write_bytes(data)
    files = A.read_files(spark, str(tmp_path), "*.epub")
    unpacked = A.entries(files)
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in A.checked(files, unpacked).collect()}
    assert problems["fine.epub"] is None
    assert problems["bad.epub"].startswith("archive is damaged") and problems["cut.epub"].startswith("archive is damaged")
    assert {r.path.rsplit("/", 1)[1] for r in A.whole(unpacked).select("path").distinct().collect()} == {"fine.epub"}


def test_archives_of_one_name_do_not_meet(spark, shelf, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "good.epub").write_bytes((shelf / "good.epub").read_bytes())
    unpacked = A.entries(A.read_files(spark, str(tmp_path / "in" / "*")))
    done = A.write_archives(unpacked, str(tmp_path / "out")).collect()
    assert len({r.output for r in done}) == 2 == len(list((tmp_path / "out").iterdir()))


def test_rebuild_and_write(spark, shelf, tmp_path):
    unpacked = A.entries(A.read_files(spark, str(shelf), "good.epub"))
    content = A.decoded(unpacked.filter(U.is_content_file(F.col("name"))))
    units = U.extract_units(content, "name", "text").filter("translatable")
    new = units.filter("ordinal < 2").select("file", "ordinal", F.lit("Đoạn <b>mới</b>").alias("translation"))
    rebuilt = U.rebuild(content, "name", "text", new).withColumnRenamed("file", "name")
    replaced = A.with_replacements(unpacked, rebuilt.withColumn("path", F.lit(unpacked.first().path)))
    done = A.write_archives(replaced, str(tmp_path / "out")).collect()
    assert [r.entries for r in done] == [88]
    assert re.fullmatch(r"good-[0-9a-f]{16}\.epub", Path(done[0].output).name)
    with zipfile.ZipFile(done[0].output) as z, zipfile.ZipFile(shelf / "good.epub") as old:
        assert z.namelist() == old.namelist()
        first = z.infolist()[0]
        assert (first.filename, first.compress_type, first.date_time) == ("mimetype", zipfile.ZIP_STORED, (2020, 1, 2, 3, 4, 6))
        text = z.read("OEBPS/Text/c1.xhtml").decode()
        assert text.count("<p>Đoạn <b>mới</b></p>") == 2 and text.count("<p>Paragraph") == 149


def test_nested_units_keep_the_outer_one(spark):
    html = "<li>one <div>two words here</div> three</li><div>leaf text here</div>"
    pages = spark.createDataFrame([("f.html", html)], "file string, html string")
    units = U.extract_units(pages, "file", "html")
    assert [(r.ordinal, r.tag) for r in units.orderBy("ordinal").collect()] == [(0, "li"), (1, "div"), (2, "div")]
    new = units.select("file", "ordinal", F.concat(F.lit("N"), "ordinal").alias("translation"))
    r = U.rebuild(pages, "file", "html", new).first()
    assert (r.content, r.misplaced) == ("<li>N0</li><div>N2</div>", 0)
    off = spark.createDataFrame([("f.html", 9, "x")], "file string, ordinal int, translation string")
    r = U.rebuild(pages, "file", "html", off).first()
    assert (r.content, r.misplaced) == (html, 1)


CSV = """﻿English,Vietnamese,Category,Note
"kidney","thận","organ","says ""hi"", ok"
only one

 Fetus ,thai\\nnhi,,
fetus,khác
,missing
x,y
"""


def test_glossary_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text(CSV, encoding="utf-8")
    terms = glossary_csv.read_glossary(spark, str(tmp_path / "g.csv"))
    rows = [(r.english, r.vietnamese, r.note) for r in terms.orderBy("ord").collect()]
    assert rows == [("kidney", "thận", 'says "hi", ok'), ("Fetus", "thai\nnhi", ""), ("fetus", "khác", ""), ("x", "y", "")]
    merged = G.merge_first_wins(terms.filter("english = 'x'"), terms)
    assert merged.filter("added").count() == 2
    out = str(tmp_path / "out")
    glossary_csv.write_glossary(merged.drop("key"), out)
    again = glossary_csv.read_glossary(spark, out)
    assert sorted(r.english for r in again.collect()) == ["Fetus", "kidney", "x"]


def test_glossary_order_over_files(spark, tmp_path):
    words = [chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(60)]
    terms = spark.createDataFrame([(i, w, w, "", "") for i, w in enumerate(words)], "ord bigint, english string, vietnamese string, category string, note string")
    out = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    glossary_csv.write_glossary(terms.repartition(5), out)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(out).glob("part-*"))) > 1
    again = glossary_csv.read_glossary(spark, out)
    assert [r.english for r in again.orderBy("ord").collect()] == words
    assert again.select("ord").distinct().count() == len(words)


def test_failed_write_keeps_the_old_state(spark, tmp_path):
    path = str(tmp_path / "state")
    one = spark.createDataFrame([("1", "f", "h", "t", "DONE", 0)], ST.STATE_SCHEMA)
    assert state.write_state(one, path) == 1
    bad = one.withColumn("translation", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        state.write_state(bad.union(one), path)
    assert [r.id for r in state.read_state(spark, path).collect()] == ["1"]
    assert state.write_state(one.limit(0), path) == 2
    assert state.read_state(spark, path).count() == 0
    pages = spark.createDataFrame([("f", 1, "t", True, P.LAYOUT_VERSION), ("f", 2, "u", False, "old")], state.PAGE_SCHEMA)
    state.write_pages(pages, str(tmp_path / "pages"))
    rows = state.read_pages(spark, str(tmp_path / "pages")).orderBy("page").collect()
    assert [(r.page, r.text, r.failed) for r in rows] == [(1, "t", True), (2, "", False)]
    state.write_manifest(one.select("id"), str(tmp_path / "manifest"))


def test_a_dead_writer_leaves_no_version(spark, tmp_path):
    """Half of a version's files, and a record without content, are never read; two writers do
    not share a number."""
    path = str(tmp_path / "state")
    one = spark.createDataFrame([("1", "f", "h", "t", "DONE", 0)], ST.STATE_SCHEMA)
    two = one.withColumn("id", F.lit("2"))
    assert state.write_state(one, path) == 1
    two.write.json(f"{path}/data/half")
    (tmp_path / "state" / "commits" / "000000000002.json").write_text("")
    assert [r.id for r in state.read_state(spark, path).collect()] == ["1"]
    # Another writer took number 3 after this one had looked.
    assert state.commit(spark, path, 1, {"folder": "data/half", "whole": True}) == 3
    assert state.commit(spark, path, 1, {"folder": "data/half", "whole": True}) == 4
    assert [r.id for r in state.read_state(spark, path).collect()] == ["2"]
    assert state.write_state(one, path) == 5
    assert [r.id for r in state.read_state(spark, path).collect()] == ["1"]


def test_pages_are_added(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = lambda *r: spark.createDataFrame([("f", p, t, x, P.LAYOUT_VERSION) for p, t, x in r], state.PAGE_SCHEMA)
    assert state.read_pages(spark, path).count() == 0
    state.write_pages(rows((1, "a", False), (2, "", True)), path)
    state.write_pages(rows((2, "b", False), (3, "c", False)), path, whole=False)
    key = lambda: sorted((r.page, r.text) for r in state.read_pages(spark, path).collect())
    assert key() == [(1, "a"), (2, "b"), (3, "c")]
    state.write_pages(rows((3, "d", False)), path)
    assert key() == [(3, "d")]


def test_marks_are_read_with_their_schema(spark, tmp_path):
    glyphs = [(1, 0, "a"), (1, 1, ""), (1, 2, None), (2, 0, "é")]
    df = spark.createDataFrame([(*g, 0.0, 0.0, 1.0, 1.0, 9.0) for g in glyphs], "page bigint, seq bigint, u string, x double, y double, w double, h double, size double")
    schema = read_marks.__globals__["SCHEMAS"]["glyphs"]
    df.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]})" for c in schema.split(", ")]).write.parquet(str(tmp_path / "g"))
    got = read_marks(spark, "glyphs", str(tmp_path / "g"))
    assert sorted((r.page, r.seq) for r in got.collect()) == [(1, 0), (2, 0)]
    assert got.schema["x"].dataType.simpleString() == "float"


def test_closure_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(12)] + [(1, 12, 3)], "page int, parent int, child int")
    roots = spark.createDataFrame([(1, 0), (2, 5)], "page int, node int")
    got = reachable(edges, roots).collect()
    assert sorted((r.page, r.node) for r in got) == [(1, i) for i in range(13)] + [(2, 5)]


def test_closure_of_a_deep_page_is_one_shuffle(spark):
    """A chain of 10,000, a cycle, links of other pages and null nodes."""
    edges = [(1, i, i + 1) for i in range(10_000)] + [(2, 1, 2), (2, 2, 1), (2, None, 9), (3, 5, 6), (None, 5, 7), (2, 1, None)]
    df = spark.createDataFrame(edges, "page int, parent bigint, child bigint")
    roots = spark.createDataFrame([(1, 0), (2, 2), (4, 1), (1, 0), (3, None)], "page int, node bigint")
    got = reachable(df, roots)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    rows = [(r.page, r.node) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(1, i) for i in range(10_001)} | {(2, 1), (2, 2), (4, 1)}
    words = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "page int, parent string, child string")
    start = spark.createDataFrame([(1, "a")], "page int, node string")
    assert {r.node for r in reachable(words, start).collect()} == {"a", "b"}


def test_state_roundtrip_and_merge(spark, tmp_path):
    path = tmp_path / "units"
    path.mkdir()
    (path / "a.json").write_text(
        '{"id":"1","file":"f","source_hash":"h","translation":"t","status":"DONE","attempts":0}\n'
        '{"id":"2","source_hash":"h2"}\nnot json\n'
    )
    saved = state.read_state(spark, str(path))
    assert [(r.id, r.translation, r.status, r.attempts) for r in saved.orderBy("id").collect()] == [
        ("1", "t", "DONE", 0), ("2", "", "DONE", 0),
    ]
    new = spark.createDataFrame([("2", "f", "h2", "u", "DONE", 1), ("3", "f", "h", "", "SOURCE_ONLY", 3)], ST.STATE_SCHEMA)
    once = ST.merge(saved, new)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ST.merge(once, new)) == key(once) and once.count() == 3
    state.write_state(once, str(tmp_path / "next"))
    assert key(state.read_state(spark, str(tmp_path / "next"))) == key(once.select("id", "file", "source_hash", "translation", "status", "attempts"))
    units = spark.createDataFrame([("1", "h", "A source text", True), ("2", "stale", "B source text", True)], "id string, source_hash string, inner string, translatable boolean")
    got = {r.id: r.done for r in ST.recover(units, once).collect()}
    assert got == {"1": True, "2": False}


def test_log_lines(spark, tmp_path):
    rows = spark.createDataFrame([(5, "A", "a|b\nc"), (9, "B", "id")], "o bigint, stage string, message string")
    lines = logs.log_lines(rows.withColumn("ts", F.lit("2024-01-02 03:04:05.678").cast("timestamp")), "o")
    logs.append_log(lines, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == [
        "2024-01-02 03:04:05.678 #1 A a/b c", "2024-01-02 03:04:05.678 #2 B id",
    ]
