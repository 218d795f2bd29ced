"""Main text of a page: the contiguous run of its tokens with the largest sum of scores.

Words score positive and tags negative. The weights come from pages that say themselves where
their article is; one linear scan finds the best run, also on pages that do not. What lies
inside one element costs a bounded amount, so that a table does not cut an article in two, and
the run is completed by the article element that holds it, if there is one."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pages (as expected, by a hash of the key) that the weights are learned from.
SAMPLE_ROWS = 5_000

#: Quotes delimit a value directly behind an equals sign only; elsewhere they are plain.
TAG = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*|))*+)>"
)
#: A tag that does not parse (a quote that takes the rest of the page) ends at the next ">".
BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
SPACE = re.compile(r"\s+")

# Fixed values of the format: elements without an end, elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noframes".split())
#: Elements that begin a block of their own.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Other elements with a weight of their own; all that are in none of these lists share one.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var picture button select canvas svg audio video object".split()
)
#: Elements whose end may be left out: what a start tag ends, and what hides it from that.
TABLE_PARTS = ("tbody", "thead", "tfoot")
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), BLOCK - {"address", "div", "p", "li", "body", "br", "hr"}),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", *TABLE_PARTS})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    **{x: (frozenset({"dt", "dd"}), BLOCK - {"address", "div", "p", "dt", "dd"}) for x in ("dt", "dd")},
    **{x: (frozenset({*TABLE_PARTS, "tr", "td", "th"}), frozenset({"table"})) for x in TABLE_PARTS},
}
ENDS_P = BLOCK - {
    "body", "br", "caption", "head", "html", "legend", "li", "option", "select", "dt", "dd", "td", "th", "tr", *TABLE_PARTS,
}
AROUND_P = frozenset("button caption html object table td template th".split())

#: Elements, and words in a class, an id or a role, of what is not the article.
APART = frozenset(
    "nav header footer aside form menu head button select svg canvas dialog object audio video".split()
)
APART_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary contentinfo cookie cookies consent disqus disclaimer footer header login "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promotion related replies reply respond search share sharing sidebar signup "
    "skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
#: In a compound name such a word counts at its end, or before one of these or a number: it is
#: "site-header" and "share-buttons", but not "social-science".
HOLDERS = frozenset(
    "area author bar block body bottom box buttons button col column container content field form group "
    "holder icons inner item items left layer link links list menu meta nav panel posts right row section "
    "slot space stories text thread top unit widget widgets wrap wrapper zone".split()
)
#: A compound name that begins with one of these says something about another element.
ABOUT = frozenset("has with without no non not is hide show".split())
#: A part named by a class, or a form, that leaves less than this share of a page's words outside
#: is the page itself. So is a part that never ends and leaves less than half.
REST, REST_OPEN = 0.02, 0.5
#: Least weight of the tags that frame an article, and of parts that do not belong: what they
#: hold is left out anyway, so that an advert in an article does not cut it in two.
LEAST = {"article": -10.0, "main": -10.0, "body": -10.0, "html": -10.0, "head": -10.0, "apart": -0.05}
#: Most that one element, or neighbours with the same tag, can cost a run that goes on behind it.
ELEMENT_COST = 20.0


@dataclass(slots=True)
class Token:
    name: str  # feature: "<p", "</p", "word" or "link"; "apart" for parts that do not belong
    words: int = 0
    text: str = ""
    ends: bool = False  # a block begins here
    inside: bool = False  # in the article that the page marks
    part: int = -1  # innermost of ``Page.parts`` that holds it
    closes: int = 0  # elements that end here: before a start tag, with an end tag
    opens: str = ""  # element that begins here


@dataclass(slots=True)
class Part:
    """An element that looks as if it did not belong to the article."""

    parent: int
    named: bool  # by a class, an id or a role, or a form
    ended: bool = False  # by an end tag of its own, or as the format implies
    holds: bool = False  # the first article or main of the page
    words: int = 0


@dataclass(slots=True)
class Page:
    tokens: list[Token]
    parts: list[Part]
    articles: list[list[int]]  # first and one past the last token of article and main elements


def _apart_name(name: str) -> bool:
    """Whether one name in a class, an id or a role says that an element is apart."""
    if name in APART_WORDS:
        return True
    parts = PARTS.findall(name)
    if not parts or parts[0] in ABOUT:
        return False
    return any(
        p in APART_WORDS and (q is None or q in HOLDERS or q.isdigit())
        for p, q in zip(parts, [*parts[1:], None])
    )


def apart(name: str, attributes: str) -> int:
    """Whether an element is a menu, header, footer, advert, form or the like: 2 if its tag says
    so, 1 if a name does or it is a form, else 0."""
    if name in APART:
        return 1 if name == "form" else 2
    if not attributes or name in ("body", "html"):
        return 0
    return int(any(
        _apart_name(part) for m in NAMES.finditer(attributes) for part in m[1].strip("\"'").lower().split()
    ))


def _feature(name: str) -> str:
    return name if name in BLOCK or name in VOID or name in INLINE else "other"


def read(page: str) -> Page:
    """Tags and pieces of text, in one pass. Comments, scripts and the like are left out; a
    tag, comment or script that is never closed takes the rest of the page with it, but an empty
    one (``<script src=x />``) only what there is up to an end tag of its own. An end tag closes
    all that was opened inside its element; one without a beginning counts for nothing. Ends
    that may be left out are implied."""
    out = Page([], [], [])
    add = out.tokens.append
    stack: list[str] = []
    depth: Counter[str] = Counter()
    off: list[tuple[int, int]] = []  # height of the stack and number of the parts that are open
    open_articles: list[int] = []
    at, size = 0, len(page)

    def pop(own: bool) -> str:
        last = stack.pop()
        depth[last] -= 1
        if off and off[-1][0] >= len(stack):
            out.parts[off.pop()[1]].ended = own
        if last in ("article", "main"):
            out.articles[open_articles.pop()][1] = len(out.tokens) + 1
        return last

    def implied(name: str) -> int:
        closes, hidden = ENDS.get(name, (frozenset(), frozenset()))
        if name in ENDS_P and depth["p"]:
            closes, hidden = closes | {"p"}, AROUND_P
        if not any(depth[c] for c in closes):
            return 0
        low = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in closes:
                low = i
                if name not in TABLE_PARTS and name != "tr":
                    break
            elif stack[i] in hidden:
                break
        if low is None:
            return 0
        n = len(stack) - low
        for _ in range(n):
            pop(True)
        return n

    while at < size:
        cut = page.find("<", at)
        while cut >= 0 and not (cut + 1 < size and (page[cut + 1] in "!/?" or page[cut + 1].isalpha())):
            cut = page.find("<", cut + 1)
        piece = page[at:cut] if cut >= 0 else page[at:]
        part = off[-1][1] if off else -1
        if piece:
            text = entities.unescape(piece) if "&" in piece else piece
            words = len(text.split())
            add(Token("link" if depth["a"] else "word", words, text, False, bool(open_articles), part))
            if off:
                out.parts[part].words += words
        if cut < 0:
            break
        if page.startswith("<!--", cut):
            end = page.find("-->", cut + 4)
            if end < 0:
                break
            at = end + 3
            continue
        m = TAG.match(page, cut) or BROKEN.match(page, cut)
        if m is None:
            end = page.find(">", cut) if page[cut + 1] in "!?" or page.startswith("</", cut) else -1
            if end < 0:
                break
            at = end + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            closed, inside = 0, bool(open_articles)
            if depth[name]:
                while True:
                    closed += 1
                    # Only the element's own end tag, and ends that may be left out, end a part.
                    if pop(stack[-1] == name or stack[-1] in ENDS or stack[-1] == "p") == name:
                        break
            inside = inside and bool(open_articles)
            add(Token("</" + _feature(name), 0, "", name in BLOCK, inside, part, closed))
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if m[3].endswith("/") and close is not None:
                again = re.compile(rf"<{name}\b", re.I).search(page, at, close.start())
                close = None if again else close
            if close is not None:
                at = close.end()
            elif not m[3].endswith("/"):
                break
            continue
        closed = implied(name)
        part = off[-1][1] if off else -1
        goes = apart(name, m[3])
        alone = name in VOID or m[3].endswith("/")
        if goes and not alone:
            out.parts.append(Part(part, goes == 1))
            part = len(out.parts) - 1
        token = Token("<" + _feature(name), 0, "", name in BLOCK, bool(open_articles), part, closed)
        add(token)
        if alone:
            continue
        token.opens = name
        if goes:
            off.append((len(stack), part))
        elif name in ("article", "main") and not out.articles:
            for _, i in off:
                out.parts[i].holds = True
        if name in ("article", "main"):
            open_articles.append(len(out.articles))
            out.articles.append([len(out.tokens) - 1, -1])
        stack.append(name)
        depth[name] += 1
    for i in open_articles:
        out.articles[i][1] = len(out.tokens)
    _leave_out(out)
    return out


def _leave_out(page: Page) -> None:
    """Name the tokens of parts that do not belong, unless a part holds the article or, as far
    as a class can be trusted, nearly all of the page."""
    parts = page.parts
    if not parts:
        return
    total = sum(t.words for t in page.tokens)
    for i in range(len(parts) - 1, -1, -1):
        if parts[i].parent >= 0:
            parts[parts[i].parent].words += parts[i].words
    gone = []
    for p in parts:
        rest = total - p.words
        own = not p.holds and not (p.named and rest < REST * total) and (p.ended or rest >= REST_OPEN * total)
        gone.append(own or (p.parent >= 0 and gone[p.parent]))
    for t in page.tokens:
        if t.part >= 0 and gone[t.part]:
            t.name = "apart" if t.text else "</apart" if t.name[1] == "/" else "<apart"


@dataclass
class Weights:
    of: dict[str, float]
    tag: float = -1.0  # of a tag that was not seen

    def score(self, token: Token) -> float:
        if token.text:
            return token.words * self.of.get(token.name, 0.0)
        return self.of.get(token.name, self.tag)


def fit(df: DataFrame, key: str, html: str, rows: int = SAMPLE_ROWS) -> Weights:
    """Log odds of each kind of token in and out of the article, from about ``rows`` of the
    pages that mark one; a word then scores between 0.1 and 2 (in a part that does not belong:
    -0.05), a tag -0.05 at most and -1 at least, those that frame an article -10. Only the counts
    of each kind reach the driver. Without such pages a word scores 1, one in a link 0.2, and a
    tag -1."""
    marked = df.filter(F.lower(html).rlike(r"<(article|main)\b")).select(key, html)
    total = marked.count()
    if total > rows:
        share = int(rows / total * (1 << 30))
        marked = marked.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, bool]] = Counter()
        for batch in slices(batches, html):
            for page in batch.column(0).to_pylist():
                for t in read(page or "").tokens:
                    sums[t.name, t.inside and not t.name.endswith("apart")] += t.words if t.text else 1
        rows = [(k[0], k[1], n) for k, n in sums.items()]
        a, b, c = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.string()), pa.array(b, pa.bool_()), pa.array(c, pa.int64())],
            names=["name", "inside", "n"],
        )

    counted = (
        marked.select(html).mapInArrow(count, "name string, inside boolean, n long")
        .groupBy("name", "inside").agg(F.sum("n").alias("n"))
        .collect()  # names of the lists above only
    )
    sums = {(r.name, r.inside): r.n for r in counted}
    inner = sum(n for (_, i), n in sums.items() if i)
    outer = sum(n for (_, i), n in sums.items() if not i)
    if not inner or not outer:
        return Weights({"word": 1.0, "link": 0.2, "<apart": 0.0, "</apart": 0.0})
    out = {}
    for name in {n for n, _ in sums} | {"word", "link", "apart"}:
        odds = math.log((sums.get((name, True), 0) + 0.5) / (inner + 1))
        odds -= math.log((sums.get((name, False), 0) + 0.5) / (outer + 1))
        if name in ("word", "link"):
            out[name] = min(max(odds, 0.1), 2.0)
        else:
            out[name] = max(min(odds, -0.05), LEAST.get(name.strip("</"), -1.0))
    return Weights(out)


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """First and one past the last of the run with the largest positive sum; of equal ones the
    first; (0, 0) if no sum is positive."""
    best, sum_, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += s
        if sum_ > best:
            best, found = sum_, (start, i + 1)
    return found


def best_span(tokens: list[Token], weights: Weights) -> tuple[int, int]:
    """``best_run`` over tokens, where an element costs ``ELEMENT_COST`` at most.

    At the end of an element the sum is no less than it was before it, minus that bound. Of
    neighbours with the same tag and nothing between, all count as one element."""
    best, sum_, start, found = 0.0, 0.0, 0, (0, 0)
    levels: list[tuple[str, float, int]] = []  # open elements: tag, sum and start before it
    last: dict[int, tuple[str, float, int]] = {}  # by height: the element that ended there

    def close(n: int) -> None:
        nonlocal sum_, start
        for _ in range(min(n, len(levels))):
            level = levels.pop()
            last.pop(len(levels) + 1, None)
            last[len(levels)] = level
            _, before, begin = level
            if before - ELEMENT_COST > sum_:
                sum_, start = before - ELEMENT_COST, begin

    for i, t in enumerate(tokens):
        if t.closes and t.name[1] != "/":
            close(t.closes)
        if t.opens:
            held = last.get(len(levels))
            if held is None or held[0] != t.opens:
                held = (t.opens, sum_, start)
            levels.append(held)
        elif t.words and last:
            last.pop(len(levels), None)
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += weights.score(t)
        if sum_ > best:
            best, found = sum_, (start, i + 1)
        if t.closes and t.name[1] == "/":
            close(t.closes)
    return found


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best run, one to a line, without the parts that do not belong. Where an
    article or main element holds half of the run's words, all that it holds is added."""
    whole = read(page)
    a, b = best_span(whole.tokens, weights)
    seen = [0, *accumulate(t.words for t in whole.tokens)]
    around = [
        (e - s, s, e) for s, e in whole.articles
        if 2 * (seen[min(e, b)] - seen[max(s, a)]) >= max(seen[b] - seen[a], 1) and max(s, a) < min(e, b)
    ]
    if around:
        _, s, e = min(around)
        a, b = min(a, s), max(b, e)
    blocks, now = [], []
    for t in whole.tokens[a:b]:
        if t.ends and now:
            blocks.append("".join(now))
            now = []
        elif t.text and t.name != "apart":
            now.append(t.text)
    blocks.append("".join(now))
    lines = (SPACE.sub(" ", x).strip() for x in blocks)
    return "\n".join(x for x in lines if x)


def extract(df: DataFrame, key: str, html: str, weights: Weights) -> DataFrame:
    """``(key, text)`` per row; null or empty pages, and pages without words, give an empty
    text. Row-local; repeated rows give repeated results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            out = [main_text(p or "", weights) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string())], names=[key, "text"]
            )

    name = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(run, f"{key} {name}, text string")


def with_text(df: DataFrame, html: str, weights: Weights) -> DataFrame:
    """``df`` with the page replaced by its main text, all other columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            at = batch.schema.get_field_index(html)
            out = [main_text(p or "", weights) for p in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return df.mapInArrow(run, df.schema)
