import pytest

from nearfield.llm import html_extract as M

CASES = {
    "plain": ("<html><body><nav>menu words here</nav><article><h1>T &amp; U</h1><p>one <b>two<br>three</p><p>four</article><footer>foot</footer></body></html>", "T & U\none two three\nfour"),
    "script": ('<body><script>var t="</p><p>no</p>";</script><article><p>yes, this</p><style>p{}</style></article>', "yes, this"),
    "comment": ("<body><article><!-- <p>no</p> --><p>yes</p><div class='comments'>me too</div></article>", "yes"),
    "noise": ('<body><div class="main"><p>the real text of the page</p><div class="ad box">buy</div><form><p>mail</p></form></div><div class="side-bar sidebar">links links links links links</div></body>', "the real text of the page"),
    "cut": ("<body><article><p>begun and &am", "begun and &am"),
    "space": ("<article><p> a\n\t b&nbsp;c  </p>\n<p> </p><p>d</p></article>", "a b c\nd"),
    "nested": ("<div><p>a</p><div><p>b</p></div><ul><li>c<li>d</ul></div>", "a\nb\nc\nd"),
    "inline": ("<article><p>un<b>bro</b>ken <i>word</i></p></article>", "unbroken word"),
    "links": ("<body><div class='x'><a href='1'>many many many many many links</a></div><div class='y'><p>short text</p></div></body>", "short text"),
    "sections": ("<main><article><h1>T</h1><section><p>one</p></section><section class='s2'><p>two, which is longer</p></section></article><p>after</p></main>", "T\none\ntwo, which is longer"),
    "main": ("<body><p>above</p><main><h1>T</h1><div class='x'><p>text of the page</p></div></main></body>", "T\ntext of the page"),
    "none": ("", ""),
    "class of a wrapper": ("<body><div class='wrapper has-sidebar'><article><p>all of it</p></article></div></body>", "all of it"),
    "class that says no": ("<body><div class='post no-comments'><p>the text stays</p><p>whole</p></div></body>", "the text stays\nwhole"),
    "open paragraph": ("<article><p class='share'>x<p>real text of the page</article>", "real text of the page"),
    "open item": ("<body><div><ul><li class='related'>x<li>kept, as it should be</ul><p>rest of the page</p></div></body>", "kept, as it should be\nrest of the page"),
    "open quote": ('<body><article><p>see <a href="x>y</a> there</p></article>', "see y there"),
    "inline class": ("<article><p>the <abbr class='alert'>WHO</abbr> says <span class='ad'>so</span></p></article>", "the WHO says so"),
    "title in a header": ("<body><header>site</header><article><header><h1>Title</h1></header><p>text</p><footer>by me</footer></article></body>", "Title\ntext"),
    "whole page in a form": ("<body><form><div id='aspnet'><p>the long text that the page is about</p><input><button>go</button></div></form></body>", "the long text that the page is about"),
    "menu never closed": ("<body><nav><ul><li><a href='/'>home</a></ul><article><p>text</p></article></body>", "text"),
    "button never closed": ("<body><div><button>go<p>away</div><article><p>text</p></article></body>", "text"),
    "most of it in a doubtful block": ("<article><p>short</p><div class='alert box'><p>what the article is mostly about</p></div></article>", "short\nwhat the article is mostly about"),
}


@pytest.mark.parametrize("name", CASES)
def test_single_pages(name):
    page, text = CASES[name]
    assert M.extract(page, None) == text


def test_host_outvotes_a_page(spark):
    good = "<body><div class='post p{0}'><p>{1}</p></div><div class='foot'><p>{2}</p></div></body>"
    rows = [(k, f"https://a.example/{k}", good.format(k, "long text of the article " * 4, "x"), 1) for k in range(5)]
    rows += [(5, "http://A.example:80/z", good.format(5, "brief", "a long notice at the end of this page, longer than its text"), 1)]
    rows += [(6, None, "<article>alone</article>", 1), (7, "https://b.example", None, 1), (8, "https://b.example", "", 1), (8, "https://b.example", "", 1), (9, "https://a.example/q", "<main><p>other layout</p></main>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = M.extract_pages(pages, broadcast_hosts=0).orderBy("page_id").collect()
    assert [r.text for r in got[5:]] == ["brief", "alone", "", "", "", "other layout"] and got[0].text == ("long text of the article " * 4).strip()
    assert [tuple(r) for r in M.extract_pages(pages).orderBy("page_id").collect()] == [tuple(r) for r in got]
    assert M.extract_pages(pages.limit(0)).collect() == []


def test_votes_change_what_single_pages_would_say(spark):
    """Of twenty pages, five have a legal text that is longer than the article; alone they would give that."""
    page = "<body><div class='c{0}'><div class='story'><p>{1}</p></div><div class='terms'><p>{2}</p></div></div></body>"
    rows = [(k, f"https://n.example/{k}", page.format(k, f"story {k} " * 9, "terms of use " * (30 if k % 4 == 0 else 2))) for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {k: M.extract(h, None) for k, _, h in rows}
    got = {r.page_id: r.text for r in M.extract_pages(pages.repartition(7)).collect()}
    assert all(got[k] == f"story {k} " * 8 + f"story {k}" for k in range(20))
    assert sorted(k for k in got if got[k] != alone[k]) == [0, 4, 8, 12, 16]


def test_tied_votes_and_clashing_columns(spark):
    one, two = "<div class='a'><p>long enough</p></div>", "<div class='b'><p>longer than that</p></div>"
    rows = [(1, "http://t.example/1", one, "mine", "mine"), (2, "http://t.example/2", two, "mine", "mine"), (3, "http://t.example/3", one + two, "mine", "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string")
    assert {r.page_id: r.text for r in M.extract_pages(pages).collect()} == {1: "long enough", 2: "longer than that", 3: "longer than that"}


def test_very_long_and_deep_pages():
    long = "".join(f"<p>paragraph {k} of many &amp; more</p>" for k in range(40_000))
    assert M.extract(f"<article>{long}</article>", None).count("\n") == 39_999
    assert M.extract("<div>" * 3000 + "<p>deep</p>", None) == "deep"


def test_against_plain_version_on_all_pages(spark):
    """These pages have one article each; what stands in it, block by block, is the text."""
    import html
    import re

    def plain(page):
        body = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", page or "")
        inside = re.search(r"(?s)<article>(.*?)(</article>|\Z)", body)
        parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", re.sub(r"<br[^>]*>", " ", inside[1]) if inside else "")
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        return "\n".join(x for x in texts if x)

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in M.op3_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == pages.keys() and len(got) == 250
    assert all(got[k] == plain(pages[k]) for k in got)


def test_query(spark, sf_dir):
    rows = M.op3_html_extract(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) for r in rows)
