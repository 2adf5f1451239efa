from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pairforge.llm import html_wrapper as hw


class Article(HTMLParser):
    """An independent reading of the generated pages: all text within <article>, a block a line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.now = 0, [], []

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "br":
            self.now.append(" ")
        elif tag in ("p", "h1", "div", "li"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "li", "article"):
            self.cut()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def brute(page):
    a = Article()
    a.feed(page or "")
    a.close()
    a.cut()
    return "\n".join(a.blocks)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = {r.page_id: r for r in hw.main_text(pages).collect()}
    assert got.keys() == want.keys()
    wrong = [k for k, r in got.items() if (r.url, r.text) != want[k] or r.n_chars != len(r.text)]
    for k in wrong[:3]:
        print(repr(got[k].text[-200:]), repr(want[k][1][-200:]))
    assert not wrong


SHELL = """<html><head><title>T {n}</title><style>p{{}}</style><script>if (a<b) document.write("<p>no</p>")</script></head><body class="home">
<header><a href=/>Site</a></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice"><p>We use cookies</div>
<div id=wrap>{body}<aside class='x'>Side {n}</aside></div><div class="comments"><article><p>a reader says {n}</p></article></div>
<form><input value='>'><label>Mail</label></form><footer>&copy; Site</footer></body></html>"""


def test_article_without_the_rest(spark):
    bodies = [
        ("<article><header><h1>Title &amp; more</h1><span>by X</span></header><p>One\n two&nbsp;three<p>Four <b>f</b>ive<ul><li>a<li>b</ul><div class=ad>buy</div><!-- <p>no --><p>x &lt; y &#8212; &#x41;</article>", "Title & more\nOne two three\nFour five\na\nb\nx < y — A"),
        ("<main><div class='post-body'><h2>Head</h2><p>Text</p><table><tr><td>1<td>2</table><div hidden>no</div><p style='display: none'>no</p></div></main>", "Head\nText\n1\n2"),
        ("<div class=story><h1>Plain</h1><p>First para of a page {n} without any article.</p><p>Second {n} para, long enough to matter.</p></div>", None),
        ("<article></article>", ""),
    ]
    rows = []
    for k, (body, _) in enumerate(bodies):
        for n in range(4):
            rows.append((len(rows), f"http://h{k}.example/{n}", SHELL.format(n=n, body=body.replace("{n}", str(n)))))
    odd = [None, "", "   ", "just text", "<p>unclosed <b>bold", "<article><p>cut off <a hre", "<article><p>ends &am", "<article>" + "<div>" * 300 + "deep", "<script>never closed <p>x", "<article><p>1 < 2 & 3</p></article>"]
    rows += [(100 + k, [None, "not a url", "http://[bad/", "http://odd.example/"][k % 4], t) for k, t in enumerate(odd)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, parts int")
    got = {r.page_id: r.text for r in hw.main_text(df.repartition(5)).collect()}
    for k, (_, want) in enumerate(bodies):
        for n in range(4):
            w = want if want is not None else f"Plain\nFirst para of a page {n} without any article.\nSecond {n} para, long enough to matter."
            assert got[4 * k + n] == w, (k, n)
    assert [got[100 + k] for k in range(len(odd))] == ["", "", "", "just text", "unclosed bold", "cut off", "ends &am", "deep", "", "1 < 2 & 3"]
    assert hw.main_text(df.limit(0)).collect() == []


def test_alignment_makes_optional_and_repeated_groups():
    pages = ["<body><h1>A</h1><p>x</p><p>y</p><h6><i>same</i></h6></body>", "<body><h1>B</h1><div>ad</div><p>z</p><h6><i>same</i></h6></body>"]
    a, b = map(hw.expression, pages)
    assert hw.pattern(hw.align(a, b)) == "<body><h1>#(<div>'#')?(<p>#)+<h6>'#'"
    c = hw.align(hw.expression(pages[1]), hw.expression(pages[0]))
    assert hw.pattern(c) == "<body><h1>#(<div>'#')?(<p>#)+<h6>'#'"
    assert hw.matches(list("abcde"), list("bde")) == [(0, None), (1, 0), (2, None), (3, 1), (4, 2)]


def test_very_deep_and_very_long_pages():
    deep = "<body><article>" + "<div>" * 6000 + "found" + "</div>" * 6000 + "<p>after</article>"
    assert hw.text_of(deep, hw.main_parts(hw.align(hw.expression(deep), hw.expression(deep)))) == ("found\nafter", True)
    long = "<article>" + "<p>word <b>bold</b>\n" * 20000 + "</article>"
    assert hw.text_of(long, hw.main_parts(hw.expression(long)))[0].count("\n") == 19999
    broken = "<article><p>" + "< " * 2000 + "<a href='x" * 300 + "</article>"
    assert hw.text_of(broken, hw.main_parts(hw.expression(broken)))[0].startswith("< <")


def test_very_wide_pages_lose_nothing():
    wide = "<body>" + "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26)}'>{k}</div><i>x</i>" for k in range(600)) + "<article>here</article></body>"
    node = hw.expression(wide)
    both = hw.align(node, hw.expression(wide.replace("<body>", "<body><p>new</p>")))
    for parts in (hw.main_parts(node), hw.main_parts(both)):
        text, seen = hw.text_of(wide, parts)
        assert text == "here" or not seen
    assert hw.text_of(wide, hw.main_parts(node)) == ("here", True)
    x, y = ["a", "b"] * 400, ["b", "c"] * 400
    got = hw.matches(x, y)
    assert sorted(i for i, _ in got if i is not None) == list(range(800)) and sorted(j for _, j in got if j is not None) == list(range(800))


def extracted(bodies):
    """Texts of pages of one host, by the wrapper of all of them."""
    pages = [SHELL.format(n=n, body=body) for n, body in enumerate(bodies)]
    wrapper = hw.expression(pages[0])
    for page in pages[1:]:
        wrapper = hw.align(wrapper, hw.expression(page))
    parts = hw.main_parts(wrapper)
    return [hw.text_of(page, parts) for page in pages]


def test_short_siblings_of_a_long_body_stay():
    long = "many words of the body " * 40
    got = extracted([f"<div class=story><h1>Title {n}</h1><p>lead {n}</p><div class=body>{long}{n}</div></div>" for n in range(4)])
    assert got == [(f"Title {n}\nlead {n}\n{long}{n}", True) for n in range(4)]
    # paragraphs that are divs, between headings and lists
    got = extracted([f"<div class=story><h2>Title {n}</h2><div>{long}{n}</div><div>{long}{n}</div><ul><li>item {n}</ul></div>" for n in range(4)])
    assert got == [(f"Title {n}\n{long}{n}\n{long}{n}\nitem {n}", True) for n in range(4)]
    # what is the same on every page is no reason to stay above the story
    got = extracted([f"<ul><li>Home<li>News</ul><div class=story><h1>T{n}</h1><p>text {n}</p></div>" for n in range(4)])
    assert got == [(f"T{n}\ntext {n}", True) for n in range(4)]


def test_names_within_the_article(spark):
    body = (
        "<article><div class='article-header'><h1>Title {n}</h1></div><h2 id='related-work'>Related {n}</h2><h3 id='search'>Search</h3><section id='social-history'><p>past {n}</p></section>"
        "<div id='reply-to-critics'><p>reply {n}</p></div><p class='notice'>note {n}</p><div class='share'><a>One</a><a>Two</a></div><div id='social'>follow</div><div class='ad'>buy {n}</div><p>end</p></article>"
    )
    rows = [(n, f"http://one.example/{n}", SHELL.format(n=n, body=body.format(n=n))) for n in range(4)]
    rows += [(10 + n, f"http://two.example/{n}", SHELL.format(n=n, body=f"<div id='search-page'>{body.format(n=n)}</div>")) for n in range(4)]
    got = {r.page_id: r.text for r in hw.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in got:
        n = k % 10
        assert got[k] == f"Title {n}\nRelated {n}\nSearch\npast {n}\nreply {n}\nnote {n}\nend", k


@pytest.mark.parametrize("name", ["layout-sidebar-right", "search-engine-history", "social-science", "banner-story"])
def test_no_name_drops_most_of_the_article(name):
    page = f"<html><body><nav>menu</nav><article><h1>T</h1><div class='{name}'>{'long text here. ' * 50}</div><div class='ad'>buy</div></article></body></html>"
    own = hw.expression(page)
    text, _ = hw.text_of(page, parts := hw.main_parts(own), (), hw.most_parts(own, parts))
    assert text == "T\n" + " ".join(["long text here."] * 50)


def test_readers_comments_go_however_long():
    page = "<article><p>short article</p><section class='comments'>" + "<p>I disagree at length.</p>" * 60 + "</section></article>"
    own = hw.expression(page)
    assert hw.text_of(page, parts := hw.main_parts(own), (), hw.most_parts(own, parts))[0] == "short article"


@pytest.mark.parametrize("n", [4, 5, 12])
def test_what_every_article_says_stays_however_many_pages(spark, n):
    """A motto in each article is kept on hosts of any size, in whatever order and partitions pages come; a doubtful name goes only where the text never varies."""
    body = "<article><h2>Summary</h2><p class='lead'>Every issue opens with this motto.</p><p>Text number {0} of many.</p><div class='share'>Share this</div><div class='notice'>Notice {0} of the board</div></article>"
    df = spark.createDataFrame([(k, f"http://h/{k}", body.format(k)) for k in range(n)], "page_id long, url string, html string")
    want = {k: f"Summary\nEvery issue opens with this motto.\nText number {k} of many.\nNotice {k} of the board" for k in range(n)}
    for parts in (1, 5):
        assert {r.page_id: r.text for r in hw.main_text(df.orderBy("page_id", ascending=parts == 1).repartition(parts)).collect()} == want


@pytest.mark.parametrize("name,goes", [("comment-analysis", False), ("reply-rates", False), ("signup-data", False), ("ad-hoc", False), ("comments-list", True), ("ad-slot-300x250", True), ("newsletterSignup", True), ("reply_form", True)])
def test_a_name_marks_only_by_words_for_boxes(spark, name, goes):
    pages = [(k, f"http://h/{k}", f"<article><p>The report of day {k} tells at length what happened then and there.</p><div class='{name}'>In part {k}.</div></article>") for k in range(6)]
    got = {r.page_id: r.text for r in hw.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"The report of day {k} tells at length what happened then and there." + ("" if goes else f"\nIn part {k}.") for k in range(6)}


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_alignment_is_a_longest_one(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    for bits in (1 << 31, 8):
        hw.MATRIX_BITS, old = bits, hw.MATRIX_BITS
        try:
            got = hw.matches(x, y)
        finally:
            hw.MATRIX_BITS = old
        assert [i for i, _ in got if i is not None] == list(range(len(x))) and [j for _, j in got if j is not None] == list(range(len(y)))
        both = [(i, j) for i, j in got if i is not None and j is not None]
        assert len(both) == best[0][0] and all(x[i] == y[j] for i, j in both)


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "text below"
    own = hw.expression(deep)
    assert hw.text_of(deep, hw.main_parts(own))[0] == "text below" and hw.flat(hw.nested(hw.flat(own))) == hw.flat(own)
    wide = "<article>" + "".join(f"<p>p{k}</p><h3>h{k}</h3>" for k in range(3000)) + "</article>"
    own = hw.align(hw.expression(wide), hw.expression(wide.replace("<h3>h7</h3>", "")))
    assert hw.text_of(wide, hw.main_parts(own), hw.same_parts(own))[0].count("\n") == 5999
    assert len(list(hw.events('<a href="x>' * 50000))) > 0
