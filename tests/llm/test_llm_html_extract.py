import math
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.html_extract import LEAST, extract, importances, main_text, style_counts

PAGES = "page_id bigint, url string, html string"


class Article(HTMLParser):
    """A plain reader of the one template of the test pages."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append([])
        if tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def plain(html):
    a = Article()
    a.feed(html)
    a.close()
    return "\n\n".join(t for b in a.blocks if (t := re.sub(r"[ \t\n\v\f\r]+", " ", "".join(b)).strip()))


def test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html))


@pytest.mark.parametrize(
    "body, text",
    [
        ('<article><p style="overflow:hidden">Kept</article>', "Kept"),
        ('<article><p aria-hidden="false">Kept</article>', "Kept"),
        ('<article><p data-id="share">Kept</article>', "Kept"),
        ('<article><p title="a hidden gem">Kept</article>', "Kept"),
        ('<article><p hidden>Gone</p><p aria-hidden=true>Gone</p>Kept</article>', "Kept"),
        ('<article><section id="related-work">Kept</section></article>', "Kept"),
        ("<article><header><h1>Headline</h1></header><p>Kept</article>", "Headline\n\nKept"),
        ('<div class="layout has-sidebar"><article>Kept</article></div>', "Kept"),
        ('<div class="sidebar"><article>Kept</article></div><div class="sidebar">Gone</div>', "Kept"),
        ('<article>Kept</article><div id="comments"><article class="comment">Gone</article></div>', "Kept"),
        ('<form id="all"><div>Kept, all of the page</div></form><form>Gone</form>', "Kept, all of the page"),
        ('<article>Kept<div class="ad-box">Gone</div><div class="related"><a href="/">Gone</a></div><footer>Gone</footer></article>', "Kept"),
        ('<article>a\u00a0&nbsp; b&#32;c</article>', "a b c"),
        ("<article><p don't>Kept</p></article>", "Kept"),
        ('<article><p title="x>y">Kept</p></article>', "Kept"),
        ('<a title="open>Kept <b>all</b>', "Kept all"),
        ("1 < 2 <3 a<b", "1 < 2 <3 a<b"),
    ],
)
def test_nothing_else_goes(body, text):
    assert extract(body) == text


@pytest.mark.parametrize("unit, n", [("<script", 14_000), ("a<b ", 25_000), ("<", 100_000), ('<a b=">" ', 11_000), ("<b>", 30_000), ("<div>x", 16_000), ("<ul><li>", 12_000), ("<!--", 25_000), ("&", 100_000), ("<p><button>", 9_000)])
def test_malformed_pages_take_linear_time(unit, n):
    for tail in ("", ">", "</span>" * 1000, "<h1></h1>" * 1000):
        start = time.process_time()
        extract("<article>" + unit * n + tail)
        assert time.process_time() - start < 5


class Tree(HTMLParser):
    """Element nodes of a well-formed made page: path -> (child labels, texts), texts of
    the article or the page, by plain lists."""

    def __init__(self):
        super().__init__()
        self.open, self.nodes, self.texts = [], {}, []

    def handle_starttag(self, tag, attrs):
        self.open.append(tag + "." + dict(attrs).get("class", ""))
        if len(self.open) > 1:
            self.nodes.setdefault("/".join(self.open[:-1]), ([], []))[0].append(self.open[-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if any(x in ("nav.", "footer.") for x in self.open):
            return
        for k in range(1, len(self.open) + 1):
            self.nodes.setdefault("/".join(self.open[:k]), ([], []))[1].append(data)
        if "article." in self.open or not self.has_article:
            self.texts.append(data)


def brute_importance(htmls):
    pages = {}
    for h in htmls:
        t = Tree()
        t.has_article = "<article>" in h
        t.feed(h)
        pages.setdefault(tuple(t.texts), t.nodes)  # equal main texts once
    out = {}
    for path in {p for n in pages.values() for p in n}:
        seen = [n[path] for n in pages.values() if path in n and n[path][1]]
        m = len(seen)
        if not m:
            continue
        e = 1.0
        if m > 1:
            e = max(-sum(c / m * math.log(c / m) for c in Counter(str(s[k]) for s in seen).values()) / math.log(m) for k in (0, 1))
        out[path] = 1 - (1 - e) * (1 - 1 / m)
    return out


def made(i, article):
    box = "<div class='box'>Subscribe now</div>" if i % 8 else f"<div class='box'>Special {i % 2}</div>"
    inner = f"<div class='story'>Story {i} tells of {i * 7}</div>{box}<div class='tag'>Topic {i % 3}</div>"
    return f"<body class='b'><nav>m</nav><div class='top'>Welcome</div>{'<article>' + inner + '</article>' if article else inner}<footer>f {i}</footer></body>"


@pytest.mark.parametrize("article", [True, False])
def test_against_a_brute_force_style_tree(spark, article):
    htmls = [made(i % 30, article) for i in range(45)]
    want = {round(v, 9) for p, v in brute_importance(htmls).items() if p.split("/")[-1] != "body.b"}
    rows = spark.createDataFrame([("h", h) for h in htmls], "host string, html string").repartition(3)
    got = importances(rows).collect()
    assert {round(r.importance, 9) for r in got} == want
    assert style_counts(rows).select("page").distinct().count() == 30
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(htmls)], PAGES)
    text = {r.page_id: r.text for r in main_text(pages).collect()}
    share = brute_importance(htmls)
    assert share[next(p for p in share if p.endswith("div.box"))] < LEAST  # removed, in the article as well
    for i in range(45):
        j = i % 30
        tag = f"\n\nTopic {j % 3}"
        assert text[i] == f"Story {j} tells of {j * 7}{tag}"


def test_an_article_that_a_host_repeats_is_no_evidence_against_itself(spark):
    """Repeated at any address, and with a part that differs each time."""
    same = [(i, "http://a/", "<article><div class='body'>The very same long text of the story</div></article>") for i in range(30)]
    dated = [(i, "http://b/", f"<article><div class='body'>The very same long text of the story</div><div class='at'>No {i}</div></article>") for i in range(30)]
    a, b = ({r.text for r in main_text(spark.createDataFrame(x, PAGES)).collect()} for x in (same, dated))
    assert a == {"The very same long text of the story"} and all(t.startswith("The very same long text of the story\n\nNo") for t in b)


def test_noise_and_markup():
    page = """<html><head><title>t</title></head><body class="nav-open"><header>top</header><nav>menu</nav>
    <div class="cookie-notice">we use cookies</div><article class="post"><h1>Head &amp; more</h1><p>One
    two<br>three <b>bold</b>, &copy; &#8364;<p>Next <script>var a="<p>x</p>";</script><!-- no --> one
    <ul><li>a<li>b</ul><form>send</form><div id="comments">first!</div><table><tr><td>c<td>d</table></article>
    <aside>side</aside><footer>foot</footer>"""
    assert extract(page) == "Head & more\n\nOne two three bold, © €\n\nNext one\n\na\n\nb\n\nc\n\nd"
    assert extract(None) == extract("") == extract("<nav>x</nav>") == ""
    assert extract("plain &am text < 5") == "plain &am text < 5"
    assert extract("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep\n\ner"


def test_style_tree_removes_what_a_host_repeats(spark):
    def page(i):
        return f"<body><div class=top>Welcome to the site</div><div class=text><p>Story number {i} is about {i * 7}.</p></div><section>All rights</section></body>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(100, "http://b.example/", page(1)), (101, None, None), (102, "x", "")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Story number {i} is about {i * 7}." for i in range(20))
    assert got[100].startswith("Welcome") and got[101] == got[102] == ""


def test_articles_that_a_host_repeats_stay_and_empty(spark):
    rows = [(i % 5, "http://a.example/", "<article><p>Same for all</p></article>") for i in range(30)]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    got = main_text(df).collect()
    assert len(got) == 30 and {r.text for r in got} == {"Same for all"}
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0
