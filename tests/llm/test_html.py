"""Main text against the article that pages mark, and the scan against all runs."""

import html as entities
import random
import re

import pytest

from foliospark.llm import html, queries

SF_DIR = "/root/testdata/sf0.01"


def test_best_run_by_all_runs():
    rng = random.Random(1)
    for _ in range(500):
        scores = [rng.choice((-3, -1, 0, 1, 2)) for _ in range(rng.randint(0, 12))]
        a, b = html.best_run(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(best, 0)


def marked(page):
    """The article's text by plain cutting, for the simple markup of the given pages."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", inside)
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in blocks]
    return "\n".join(x for x in blocks if x)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = queries.op9_main_text(spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == marked(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.fixture(scope="module")
def weights(spark):
    return html.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"), "page_id", "html")


def test_other_pages(weights):
    words = "some words of a story that goes on for quite a while "
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header>
    <div id=content><h2>Head</h2><p>{words}&lt;b&gt; &eacute;</p><div class="ad box">buy</div>
    <ul><li>one</li><li>two</li></ul><form><input value="x>y"><label>mail</label></form>
    <p title="a>b">{words}<i>x</i> < y<!-- no --><script>"</p>"</script></p>
    <section class="comments"><p>{words}</p></section></div>
    <aside><p>{words}</p></aside><footer>{words}</footer></body></html>"""
    w = words.strip()
    assert html.main_text(page, weights) == f"Head\n{w} <b> é\none\ntwo\n{words}x < y"


def test_broken_pages(weights):
    for page in ("", "<", "<<<", "<p", "<!--", "<p>a &am", "</p></div>", "<script>", "no tags", "<a b='c", "<p>&amp"):
        assert isinstance(html.main_text(page, weights), str)
    assert html.main_text("no tags", weights) == "no tags"
    assert html.main_text("<p>a &am", weights) == "a &am"
    for part in ("<", "<!--", "<a \"", "<p>", "</p>", "<div>", "&", "<script>", "<nav>x"):
        html.main_text(part * 50_000, weights)


def test_edges(spark, weights):
    rows = [(1, None, "x"), (2, "", None), (None, "<p>a b</p>", "x"), (2, "", None), (3, "word " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html.extract(df, "page_id", "html", weights).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 3), (1, 0), (2, 0), (2, 0), (3, 999_999)]
    none = html.fit(df.limit(0), "page_id", "html")
    assert html.main_text("<p>a b</p>", none) == "a b"
    assert html.extract(df.limit(0), "page_id", "html", none).count() == 0
    assert html.with_text(df, "html", none).columns == df.columns


def test_stray_quotes_in_tags(weights):
    for page, text in (
        ("<img alt=Bob's><p>all text here</p>", "all text here"),
        ('<p class="a"">hello</p><p>you</p>', "hello\nyou"),
        ("<img alt=Bob's><p>we don't know</p>", "we don't know"),
        ("<p it's>one</p><p title='a>b' x = \"c>d\">two</p>", "one\ntwo"),
        ("<p title=\"a>one</p><p>two</p>", "one\ntwo"),
        ("<p title='a>one</p><p>it's two", "one\nit's two"),
        ('<p title=x?a="b>one</p> "two"', 'one\n"two"'),
    ):
        assert html.main_text(page, weights) == text
    for part in ("<a b=\"", "<a b='>", "<a b=\">'", "<a =", "<a b=  "):
        html.main_text(part * 50_000, weights)


TEXT = "some words of a story that goes on for quite a while"
#: Pages made by hand (``#`` stands for the article's text, ``@`` for words that do not belong),
#: and what is to be left of them.
HAND_MADE = [
    ('<script src="a.js"/><p>#</p>', "#"),
    ('<script src="a.js"/></script><p>#</p>', "#"),
    ('<script src="a.js"/><p>#</p><script>x()</script>', "#"),
    ("<title/><article><p>#</p></article>", "#"),
    ("<title/>T</title><article><p>#</p></article>", "#"),
    ('<div class="content has-sidebar"><article><p>#</p></article></div>', "#"),
    ('<div class="content has-sidebar"><article><p>#</p></article><div class="sidebar">@</div></div>', "#"),
    ('<div class="no-comments"><p>#</p></div>', "#"),
    ('<form id=aspnetForm><div><p>#</p></div></form>', "#"),
    ('<form id=aspnetForm><div><p>#</p></div><div class="footer">@</div></form>', "#"),
    ('<div class="social-science"><p>#</p></div><p>#</p>', "#\n#"),
    ('<div class="ad-hoc"><p>#</p></div><p>#</p>', "#\n#"),
    ('<p>#</p><div class="share-buttons">@</div>', "#"),
    ('<p>#</p><div class="comment-17"><p>@</p></div>', "#"),
    ('<div class="site-header"><p>@</p></div><p>#</p>', "#"),
    ('<div id="post__comments--list">@</div><p>#</p>', "#"),
    ("<body><nav><a href=x>@</a><article><p>#</p></article></body>", "#"),
    ("<body><nav><a href=x>@</a></nav><article><p>#</p></article></body>", "#"),
    ("<main><article><p>#</p></article><div class=comments><article><p>@</p></article></div></main>", "#"),
    ("<article><p>#</p></article><aside><article><p>@</p></article></aside>", "#"),
    ('<p class="ad">@<p>#', "#"),
    ('<ul><li class="share">@<li>#</ul>', "#"),
    ('<ul><li class="share"><ul><li>@</ul><li>#</ul>', "#"),
    ('<dl><dt class="ad">@<dd>#</dl>', "#"),
    ('<table><tr><td class="ad">@<td>#</table>', "#"),
    ('<table><thead class="menu"><tr><th>@<tbody><tr><td>#</table>', "#"),
    ('<table><tr class="ad"><td>@<td>@<tr><td>#</table>', "#"),
    ('<p class="ad">@<div>#</div>', "#"),
    ('<div><p>#</p><div class="notice"><div><p>@</div></div><p>#</p></div>', "#\n#"),
    ("<article><h1>#</h1><header>@</header><p>#</div></p><footer>@</footer></article>", "#\n#"),
    ("<article><p>#<p><b>#</article><footer>@", "#\n#"),
    ("<p>#</p><footer>@", "#"),
    ("<article><p>#</p><form>@</form><select><option>@<option>@</select><p>#</article>", "#\n#"),
    ("<x-app><y-part><p>#</p></y-part></x-app>", "#"),
]


@pytest.mark.parametrize("page,want", HAND_MADE)
def test_hand_made_pages(weights, page, want):
    def fill(x):
        return x.replace("#", TEXT).replace("@", "not of it")

    assert html.main_text(fill(page), weights) == fill(want)


@pytest.mark.parametrize("middle,words", [
    ("<table>" + "<tr><td>cell<td>1</tr>" * 80 + "</table>", 160),
    ("<figure><img src=x><figcaption>c</figcaption></figure>" * 60, 60),
    ("<div>" + "<figure><img src=x></figure>" * 60 + "</div>", 0),
    ("<ul>" + "<li><a href=x>y</a>" * 90 + "</ul>", 90),
])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_articles_with_tables_stay_whole(weights, middle, words, outer):
    """The two halves and all between, also where no element marks the article."""
    text = " ".join([TEXT] * 10)
    page = f"<body><div><a href=x>menu</a></div><{outer}><p>{text}</p>{middle}<p>{text}</p></{outer}></body>"
    got = html.main_text(page, weights)
    assert got.split().count("story") == 20
    assert len(got.split()) == 2 * len(text.split()) + words + (got.split()[0] == "menu")


def test_cost_of_an_element_is_bounded():
    tokens = html.read("<p>" + "a " * 30 + "<div>" + "<i></i>" * 500 + "</div>" + "b " * 30).tokens
    weights = html.Weights({"word": 1.0})
    a, b = html.best_span(tokens, weights)
    assert sum(t.words for t in tokens[a:b]) == 60
    weak = html.read("<p>" + "a " * 30 + "<div>" + "<i></i>" * 500 + "</div>" + "b " * 15).tokens
    a, b = html.best_span(weak, weights)
    assert sum(t.words for t in weak[a:b]) == 30
    rng = random.Random(4)
    for _ in range(300):  # without elements it is the best run
        tokens = [html.Token("</x" if rng.random() < 0.5 else "word", rng.randint(1, 3)) for _ in range(9)]
        for t in tokens:
            t.text = "w" if t.name == "word" else ""
        assert html.best_span(tokens, weights) == html.best_run([weights.score(t) for t in tokens])


def test_given_names_only_reach_the_driver(spark):
    rows = [(i, f"<article><x{i}>a b</x{i}></article><y{i}>c</y{i}>") for i in range(200)]
    fitted = html.fit(spark.createDataFrame(rows, "page_id long, html string"), "page_id", "html")
    assert set(fitted.of) == {"word", "link", "apart", "<article", "</article", "<other", "</other"}
