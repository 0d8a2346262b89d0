"""Visible text of pages with nested, unclosed and stray blocks, and named and numeric characters."""

import html as standard
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from leadweave.operators import measure

CASES = [
    ("<nav>a<nav>b</nav>c</nav>d", "d"),
    ("a<footer>b<nav>c</footer>d", "a d"),
    ("<div>a<nav>b<ul><li>c</div>d", "a d"),
    ("a<nav>b", "a"),
    ("a</nav>b</footer>c", "a b c"),
    ("a<NAV class='x'>b</Nav >c", "a c"),
    ("a<navigation>b</navigation>c", "a b c"),
    ("<header>a<nav/>b</header>c", "a c"),
    ("a<script>var t='<nav>';</script>b<style>p{}</style>c<!-- <nav> -->d", "a b c d"),
    ("a<script>never closed <p>b", "a"),
    ("a<!-- never closed <p>b", "a"),
    ("<p>a<p>b<br>c</nav><b>d", "a b c d"),
    ("caf&#233; &#x41;&#X42; &amp;#65; &#38;lt; &lt;b&gt; &#0;&#xD800;&#9999999; &apos;x&apos; &copy;", "café AB &#65; &lt; <b> \ufffd\ufffd\ufffd 'x' &copy;"),
    ("a&nbsp;&#160;b\n\t c", "a b c"),
    ("", ""),
    (None, ""),
]


def test_visible_text(spark):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page_id int, html string")
    got = {r["page_id"]: r["t"] for r in pages.select("page_id", measure.visible_text(F.col("html")).alias("t")).collect()}
    for i, (page, want) in enumerate(CASES):
        assert got[i] == want, page


class Reader(HTMLParser):
    """The text outside nav and footer, by a list of open containers."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        self.text.append(" ")
        if tag in measure.CONTAINERS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.text.append(" ")
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not set(self.open) & set(measure.UNREAD):
            self.text.append(data)

    def handle_entityref(self, name):
        self.handle_data(standard.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(standard.unescape(f"&#{name};"))


def test_visible_text_by_brute_force(spark):
    r = random.Random(4)
    bits = [f"<{s}{t}{a}>" for t in ("nav", "footer", "div", "ul", "li", "p", "b", "section") for s in ("", "/") for a in ("", " ")] + ["&amp;", "&#8364;", "&#x3b1;", "<!-- x -->", "<script>1<2</script>"]
    rows = [(i, "".join(r.choice(bits) if r.random() < 0.5 else f"w{r.randint(0, 99)} " for _ in range(r.choice((5, 40, 400))))) for i in range(150)]
    got = {x["page_id"]: x["t"] for x in spark.createDataFrame(rows, "page_id int, html string").select("page_id", measure.visible_text(F.col("html")).alias("t")).collect()}
    for i, page in rows:
        reader = Reader()
        reader.feed(page.replace("<script>1<2</script>", " ").replace("<!-- x -->", " "))
        reader.close()
        assert got[i] == " ".join("".join(reader.text).split()), page


def test_page_features_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id int, html string")
    assert measure.page_features(pages, ["roof"]).count() == 0


@pytest.mark.parametrize("tags", [3000])
def test_pages_of_many_tags(spark, tags):
    page = "<div>x<nav>" * tags + "end"
    got = measure.page_features(spark.createDataFrame([(1, page)], "page_id int, html string"), ["x", "end"]).first()
    assert got["excerpt"] == "x" and got["keywords"] == ["x"]
