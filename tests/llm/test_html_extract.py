import random
import time
from html.parser import HTMLParser

import pytest

from palaver.llm import html_extract as op

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad 7 --><div class="ad">Buy this, buy that, and buy more, at once.</div>'
    "<article><h1>T &amp; t</h1>{}</article><footer>&copy; host &middot; Foot.</footer></body></html>"
)

CASES = [
    ("<p><b>One, two.<br><p>Three &lt;x&gt;&amp;&amp; four</p><p> </p><p>Five\n six&nbsp;seven</p>", "T & t\nOne, two.\nThree <x>&& four\nFive six seven"),
    ("", "T & t"),
    ("<p>a<script>no()</script>b</p><style>p</style><p>&am &#233;&#x1F600; &zzz;</p>", "T & t\nab\n&am é😀 &zzz;"),
    ("<p>Main</p><form><p>Name</p><input></form><aside>Side</aside><div class='comments'><p>Reader</p></div>", "T & t\nMain"),
    ("<p>x <span class='ad'>buy</span> y</p><div id=cookie-notice>Cookies</div><div role='navigation'>n</div><div hidden>h</div>", "T & t\nx y"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "T & t\none\ntwo\na\nb\nc"),
    ("<p title='a>b'>ok</p><p>1 < 2</p><P CLASS=\"Lead\">Up</P>tail", "T & t\nok\n1 < 2\nUp\ntail"),
    ("<header><h2>Sub</h2><div>By someone</div></header><p>Text</p>", "T & t\nSub\nText"),
]


@pytest.mark.parametrize("body, want", CASES)
def test_pages(body, want):
    assert op.extract(PAGE.replace("{}", body)) == want
    assert op.extract(PAGE.replace("{}", body), op.vote(PAGE.replace("{}", body))[0]) == want


def test_broken_pages():
    for t in ("", "   ", "<", "<p", "</p></div>", "<!-- never ends", "<script>never ends", '<p class="x>y</p>', "&", "<p>" * 3000, "<div>" * 2000 + "x", "a<b>c"):
        op.extract(t)
    assert op.extract("plain words") == "plain words"
    began = time.time()
    op.extract(PAGE.replace("{}", "<p>word &amp; word</p>" * 20000))
    op.extract("<p class=\"a" * 2000)
    assert time.time() - began < 20


def test_host_votes_overrule_a_page(spark):
    """A page whose largest container is a long list of offers is read from the path that its host's pages agree on."""
    good = "<body><div class='c1 story7'><p>{}</p><p>Second, part.</p></div><div class='offers'><p>{}</p></div></body>"
    long, short = "words, and more words, " * 30, "a, b"
    rows = [(i, f"https://A.example/p{i}?q", good.format(long + str(i), short), 1) for i in range(9)]
    rows += [(20, "http://a.example/odd", good.format("Brief", long * 3), 1), (21, "http://b.example/", good.format("Brief", long * 3), 1)]
    rows += [(22, None, "<article><p>No url</p></article>", 1), (23, "nohost", None, 1), (22, "http://c/", "<p>again</p>", 1), (None, "http://c/#x", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = op.html_extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[20, "http://a.example/odd"] == "Brief\nSecond, part."
    assert by[21, "http://b.example/"].startswith("words, and")
    assert by[22, None] == "No url" and by[23, "nohost"] == "" and by[None, "http://c/#x"] == ""
    paths = {r.host: r.path for r in op.host_paths(df).collect()}
    assert paths["a.example"] == ">body>div.c.story"
    assert op.html_extract(df.limit(0)).collect() == []


def test_hosts(spark):
    urls = ["http://Ab.C:80/x", "x://é.ÀB?y", "a/b", "://h#f", "", None, "http://u@H//://z"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(op.host_of(F.col("url"))).collect()] == ["ab.c:80", "é.Àb", "", "h", "", "", "u@h"]


def test_deep_and_long_pages_in_linear_time():
    """Nests, lists without ends and ends without beginnings take time in proportion."""
    n = 20000
    pages = [
        "<div><p>word " * n,
        "<div>" * n + "<p>text, text</p>" + "</div>" * n,
        "<ul>" + "<div>" * n + "<li>one" * n,
        "<table><tr>" + "<div>" * n + "<td>x" * n,
        "<div>" * n + "</section>" * n,
        "<svg>" * n + "<noscript>" * n + "<p>x",
        "<p title='" * n,
    ]
    for page in pages:
        began = time.time()
        path, _ = op.vote(page) or (None, 0)
        op.extract(page, path)
        assert time.time() - began < 10, page[:20]


class Brute(HTMLParser):
    """The text of the blocks of the first element ``inside``, for pages whose elements all end; another parser than the operator's."""

    BLOCKS = {"p", "div", "ul", "li", "h1", "h2", "article", "section", "blockquote", "table", "tr", "td", "main"}
    OFF = {"nav", "aside", "footer", "form", "script", "style"}

    def __init__(self, inside):
        super().__init__(convert_charrefs=True)
        self.inside, self.depth, self.off, self.out, self.run = inside, 0, 0, [], []

    def flush(self):
        own = " ".join("".join(self.run).split())
        self.out += [own] if own else []
        self.run = []

    def handle_starttag(self, tag, attrs):
        if self.depth or dict(attrs).get("class") == self.inside or tag == self.inside:
            if tag in self.BLOCKS or tag in self.OFF:
                self.flush()
            if tag == "br":
                self.run.append(" ")
            else:
                self.depth += 1
            self.off += tag in self.OFF or (dict(attrs).get("class") or "") in ("ad", "comments", "share")
            self.stack = [*getattr(self, "stack", []), (tag, tag in self.OFF or (dict(attrs).get("class") or "") in ("ad", "comments", "share"))] if tag != "br" else self.stack

    def handle_endtag(self, tag):
        if self.depth:
            if tag in self.BLOCKS or tag in self.OFF:
                self.flush()
            self.depth -= 1
            self.off -= self.stack.pop()[1]

    def handle_data(self, data):
        if self.depth and not self.off:
            self.run.append(data)


def brute(page, inside):
    b = Brute(inside)
    b.feed(page)
    return "\n".join(b.out)


def made_page(rnd, shell):
    """A page of one of three hosts' layouts, with what is not main text around and inside the article."""
    word = lambda: rnd.choice(["wind", "river,", "stone", "über", "a &amp; b", "&lt;x&gt;", "light&nbsp;blue", "<b>bold</b>", "<a href='/l'>link</a>", "half\n line"])
    para = lambda lo, hi: "<p>" + " ".join(word() for _ in range(rnd.randrange(lo, hi))) + "</p>"
    inner = [para(20, 60) for _ in range(rnd.randrange(3, 8))]
    extra = ["<div class='ad'><p>Buy, buy, buy</p></div>", "<ul><li>first point, and more</li><li>second</li></ul>", "<blockquote><p>said, once</p></blockquote>", "<form><p>Name</p></form>", "<div class='share'>Share</div>", "<aside><p>By the way, aside</p></aside>", "<script>var a = '<p>';</script>", "x<br>y"]
    for x in rnd.sample(extra, 4):
        inner.insert(rnd.randrange(len(inner)), x)
    nav = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>B</a></li></ul></nav>"
    foot = "<div class='comments'>" + para(5, 60) * rnd.randrange(6) + "</div><footer><p>&copy; all</p></footer>"
    return f"<html><head><title>t</title></head><body>{nav}<div class='ad'>ad</div>" + shell.replace("{}", "<h1>Title, here</h1>" + "".join(inner)) + foot + "</body></html>"


SHELLS = [("article", "<article>{}</article>"), ("story", "<div class='wrap'><div class='story'>{}</div></div>"), ("body7", "<section><main class='body7'>{}</main></section>")]


def test_query_as_brute_force(spark, monkeypatch):
    """All pages of made-up hosts and of the smallest tables, by another parser that is told where the article is; broadcast and joined."""
    rnd = random.Random(9)
    rows = [(i, f"https://host{i % 3}.example/{i}", made_page(rnd, SHELLS[i % 3][1])) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: brute(h, SHELLS[i % 3][0]) for i, _, h in rows}
    assert all(len(t) > 200 for t in want.values())
    for most in (op.BROADCAST_BYTES, 0):
        monkeypatch.setattr(op, "BROADCAST_BYTES", most)
        assert {r.page_id: r.text for r in op.html_extract(df).collect()} == want
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    closed = lambda h: h.replace("<p><b>", "<p>").replace("<br><p>", "<br></p><p>")  # noqa: E731 - the tables leave these open
    want = {r.page_id: brute(closed(r.html), "article") for r in pages.collect()}
    assert {r.page_id: r.text for r in op.html_extract(pages).collect()} == want


def test_hot_hosts_are_joined_in_place(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example/{i}", f"<article><p>text {i}, of it</p></article>") for i in range(3000)]
    got = op.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {i: f"text {i}, of it" for i, _, _ in rows}
