from traceloom.llm import html_main
from traceloom.llm.html_main import extract

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy\nnow.</div>'
    "<article><h1>Head &amp; tail</h1><p><b>First  para.<br><p>Second\n&lt;para&gt; &#233;.</p><form><input> field</form></article>"
    '<aside>side</aside><div class="comments"><p>me too</p></div><div id="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>'
)


def test_article_only():
    assert extract(PAGE, None) == "Head & tail\nFirst para.\nSecond <para> é."
    assert extract(PAGE, ">body>article") == "Head & tail\nFirst para.\nSecond <para> é."


def test_lenient_reading():
    assert extract(PAGE.replace("</article>", "").replace("</body></html>", ""), ">body>article").startswith("Head & tail\nFirst para.")
    assert extract(None, None) == extract("", ">x") == ""
    assert extract("just text &nbsp; here", None) == "just text here"
    assert extract("<div><p>a<p>b<div>c</div>d</div>", None) == "a\nb\nc\nd"
    assert extract("<p>x<script>never closed </p>", None) == "x"
    assert extract("<p title='a>b'>x</p><!-- open", None) == "x"
    assert extract("<ul><li>a<li>b</ul>", None) == "a\nb"


def test_deep_nesting_is_bounded():
    html = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert extract(html, None) == "text"


def test_host_path_wins(spark):
    good = "<body><div class='post-1'><p>%s</p></div><div class='x'><p>%s</p></div></body>"
    rows = [(i, "http://Host.a/%d" % i, good % ("long text " * 9, "x")) for i in range(5)]
    rows.append((9, "http://host.a/9", good % ("short", "a much longer odd block of text " * 9)))
    rows += [(10, None, None), (10, None, None), (11, "http://b/", "")]
    schema = "page_id long, url string, html string"
    got = {r.page_id: r for r in html_main.extract_pages(spark.createDataFrame(rows, schema)).collect()}
    assert got[9].text == "short" and got[0].text == ("long text " * 9).strip()
    assert got[10].text == "" and got[11].n_chars == 0
    assert html_main.extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_headline_and_lead_before_the_body_stay():
    body = "<div class=body><p>%s</p></div>" % ("text " * 80).strip()
    text = ("text " * 80).strip()
    for page in ("<article><h1>Head</h1><p>lead</p>%s</article>", "<div class=post><h1>Head</h1><p>lead</p>%s</div>", "<div class=post><div class=top><h1>Head</h1><p>lead</p></div>%s</div>", "<main><div><p>Head</p></div><p>lead</p>%s</main>"):
        assert extract("<body><nav>menu</nav>" + page % body + "</body>", None) == "Head\nlead\n" + text
    # A box next to the article, with neither heading nor text around it, is no part of it.
    assert extract("<body>" + body + "<div class=x><p>x</p></div></body>", None) == text


LONG = " ".join(["A sentence of the article that runs on."] * 8)


def test_stray_text_around_the_article_stays_out():
    page = "<body>Skip to content<div class=top>Best shop ever</div><article><h1>Title</h1><p>%s</p></article><div class=legal>Copyright 2024</div></body>" % LONG
    assert extract(page, None) == f"Title\n{LONG}"
    more = "<body><div><article><p>%s</p></article><div><h2>More stories</h2><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div></div></body>" % LONG
    assert extract(more, None) == LONG


def test_an_articles_own_parts_stay():
    assert extract("<article><header><h1>Title</h1></header><p>%s</p></article>" % LONG, None) == f"Title\n{LONG}"
    page = "<article><p>%s</p><div class=related-work><p>Earlier studies found less.</p></div><p class=market-share>Its share rose.</p><p>Then <math><mi>x</mi>=<mn>2</mn></math> holds.</p></article>" % LONG
    assert extract(page, None) == f"{LONG}\nEarlier studies found less.\nIts share rose.\nThen x=2 holds."
    short = "<article><p>One.</p><p>Two.</p><div><p>%s</p></div></article>" % LONG
    assert extract(short, None) == f"One.\nTwo.\n{LONG}"


def test_asides_within_an_article_go():
    inner = "<div class='ad'>A long text of an advert that reads like prose, without any link at all, for a while.</div><div class=share-buttons>Tell all</div><div class='related-reading'><a href=x>One more story that is a link</a> and</div><footer>by me</footer><section id=comments><p>I do not agree with any of this.</p></section>"
    assert extract(f"<article><p>{LONG}</p>{inner}<p>End.</p></article>", None) == f"{LONG}\nEnd."
    assert extract(f"<body><div class=site-header>Name</div><div class=entry-header><h1>T</h1></div><div class=entry><p>{LONG}</p></div></body>", None).endswith(LONG)


def test_an_article_is_not_lost_for_a_small_box_of_the_hosts_path():
    page = "<body><div class=post-1><p>short</p></div><article><p>%s</p></article></body>" % LONG
    assert extract(page, ">body>div.post-#") == LONG


def test_unclosed_elements_are_read_in_linear_time():
    import time

    for page in ("<b>" * 150_000 + "<p>x" * 120_000, "<ul><li>" * 60_000 + "x" + "</b>" * 100_000, "<p>x</i>" * 120_000, "<a>" * 100_000 + "<li>y" * 100_000):
        began = time.time()
        assert extract(page, None)
        assert time.time() - began < 8, page[:20]


def plain_article(html):
    """Blocks of the article by Python's own parser: for pages whose article is one element without asides inside."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.out = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in ("p", "h1"):
                self.out.append("")
            if tag == "br":
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag in ("p", "h1", "article"):
                self.out.append("")

        def handle_data(self, data):
            if self.depth:
                self.out[-1] += data

    r = Reader()
    r.feed(html or "")
    r.close()
    return "\n".join(t for t in (" ".join(x.split()) for x in r.out) if t)


def test_registered_query_equals_a_plain_parser_on_the_test_pages(spark):
    import os

    import pytest

    from traceloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op5_host_path_extraction"](spark, d).collect()}
    assert got == {i: plain_article(h) for i, h in html.items()}
