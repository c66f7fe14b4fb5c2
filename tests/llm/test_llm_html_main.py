import pytest

from reviewloom.llm import html_main
from reviewloom.llm.html_main import main_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"),
        ("<body><nav><ul><li>menu</ul></nav><article><h1>T</h1><p><b>One\n two.<br><p>Th&eacute; &nbsp;x</p></article><footer>f</footer>", "T\n\nOne two.\n\nThé x"),
        ('<article><p>x</p><script>if (a < b) "</p>"</script><style>p{}</style><!-- <p>no</p> --><p>y</p></article>', "x\n\ny"),
        ('<main><div class="Cookie-Notice">ok?</div><div id="adSense">buy</div><p>text</p><form><p>name</p></form></main>', "text"),
        ('<article><p>x</p><section id="comments"><article>hi</article></section></article><article class="comment">yo</article>', "x"),
        ("<article><div>un<span>clos<div>ed</article>tail", "unclos\n\ned"),
        ("<article>a</b></i></p>b</article>", "ab"),
        ("<article><ul><li>1<li>2<ul><li>3</ul><li>4</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "1\n\n2\n\n3\n\n4\n\na\n\nb\n\nc"),
        ('<article><p title="a > b" data-x=\'<p>\'>q &lt;b&gt; &#233;&#x4e2d;</p></article>', "q <b> é中"),
        ('<article><p title="never closed>x</p><p>y</p></article>', "x\n\ny"),
        ('<body class="has-sidebar"><header>h</header><p>body</p><aside>s</aside>', "body"),
        ('<article class="post"><p>1</p></article><div>between</div><article><p>2</p></article>', "1\n\n2"),
        ("<title>t</title><p>x &lt;", "x <"),
        ("<p>a < b and c <3", "a < b and c <3"),
        ("<article>  \n </article>", ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><form id="aspnetForm"><input><nav>menu</nav><article><p>x</p><form>y</form></article></form>', "x"),
        ('<div class="content has-sidebar"><article>x</article><div class="sidebar">y</div></div>', "x"),
        ('<div class="page no-banner"><form><main><p>x</p></main></form></div>', "x"),
        ('<div class="page no-banner"><h1>T</h1><p>x</p><div class="banner">y</div></div>', "T\n\nx"),
        ("<article><header><h1>T</h1><nav>menu</nav></header><p>x</p></article>", "T\n\nx"),
        ('<article><h1>T</h1>x</article><div class="sidebar"><article>teaser</article></div>', "T\n\nx"),
        ('<nav><h1>menu</h1></nav><div id="comments"><h1>C</h1><article>hi</article></div><p>x</p>', "x"),
        ('<form><nav><article>menu</article></nav><p>y</p></form><p>x</p>', "x"),
    ],
)
def test_wrappers_of_the_main_part_stay(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='comments-enabled page'><article><p>x</p></article></div>", "x"),
        ("<article><p>x</p><div class='social-history'>y</div><p class='notice-of-war'>z</p></article>", "x\n\ny\n\nz"),
        ("<article><p>x</p><section id='menu-recipe'>y</section></article>", "x\n\ny"),
        ("<article><p>x</p><div class='site-footer'>y</div><div id='topNavBar'>z</div><div class='ad-300x250'>a</div></article>", "x"),
        ("<article><p>x</p><div class='share-buttons'>y</div><div class='related-posts'>z</div><div id='user_comments'>a</div></article>", "x"),
    ],
)
def test_one_word_of_a_compound_name_does_not_decide(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    deep = "top" + "<div>" * 20_000 + "x" + "<b>" * 20_000
    assert main_text(deep) == "top\n\nx"
    assert len(html_main.candidates(deep)[1]) > 0
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert len(main_text(long)) == 50_000 * 11 - 2
    assert main_text("<" * 20_000) == "<" * 20_000


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")


def test_templates_are_found_by_counting(spark):
    page = lambda i, extra: f"<article><p>Story {i}.</p><p>Refrain.</p><div><p>Join our club</p></div>{extra}<p>End {i} of it all, long enough.</p></article>"
    rows = [(i, "http://a.org/", page(i, f"<div>own {i}</div>")) for i in range(20)]
    rows += [(100 + i, "http://b.org/", page(i, "")) for i in range(3)]  # too few pages to tell
    rows += [(200 + i, "http://c.org/", f"<body><p>Top line</p><p>Text {i} and more of it</p></body>") for i in range(10)]
    rows += [(300, None, None), (301, "", ""), (None, "http://a.org/", page(99, "")), (5, "http://a.org/", page(5, "again"))]
    got = html_main.extract(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got if r.page_id != 5}
    assert text[3] == "Story 3.\n\nRefrain.\n\nown 3\n\nEnd 3 of it all, long enough."
    assert text[101] == "Story 1.\n\nRefrain.\n\nJoin our club\n\nEnd 1 of it all, long enough."
    assert text[204] == "Text 4 and more of it" and text[300] == text[301] == ""
    assert text[None] == "Story 99.\n\nRefrain.\n\nEnd 99 of it all, long enough."
    assert sorted("again" in r.text for r in got if r.page_id == 5) == [False, True]


def test_copies_of_an_article_are_not_template(spark):
    rows = [(i, "http://a.org/x", "<article><div><p>One and the same story.</p><p>It goes on.</p></div></article>") for i in range(30)]
    assert {r.text for r in html_main.extract(frame(spark, rows)).collect()} == {"One and the same story.\n\nIt goes on."}


def test_copies_of_an_article_in_parts_are_not_template(spark):
    parts = "<h1>T</h1><div><p>One and the same story.</p></div><div><p>It goes on and on.</p></div><ul><li>a list</ul>"
    rows = [(i, "http://a.org/x", f"<nav>menu {i}</nav><article>{parts}<form>{i}</form></article>") for i in range(30)]
    rows += [(100 + i, "http://b.org/x", f"<body>{parts}</body>") for i in range(30)]
    assert {r.text for r in html_main.extract(frame(spark, rows)).collect()} == {"T\n\nOne and the same story.\n\nIt goes on and on.\n\na list"}


def test_templates_of_large_hosts_and_short_articles(spark):
    """A menu on 6 of 100 pages, and one that is longer than the articles around it."""
    menu = "<div><p>A section's own menu, and rather a long one at that</p></div>"
    rows = [(i, "http://a.org/x", f"<article><p>Story {i}, told at some length on this page.</p>{menu if i < 6 else ''}<p>The end.</p></article>") for i in range(100)]
    rows += [(200 + i, "http://b.org/x", f"<article><p>Short {i}.</p>{menu}</article>") for i in range(10)]
    rows += [(300 + i, "http://c.org/x", f"<article><nav>{i}</nav>{menu}</article>") for i in range(10)]
    text = {r.page_id: r.text for r in html_main.extract(frame(spark, rows)).collect()}
    assert text[3] == "Story 3, told at some length on this page.\n\nThe end." and text[204] == "Short 4."
    assert text[305] == "A section's own menu, and rather a long one at that"
    assert main_text(f"<article>{menu}<section>x</section></article>", frozenset(v for v, _, _ in html_main.candidates(f"<article>{menu}<section>x</section></article>")[1].values())) == "A section's own menu, and rather a long one at that"


def test_empty_table(spark):
    assert html_main.extract(frame(spark, [])).collect() == []


def test_whole_table_against_its_making(spark):
    """The given pages hold their text between <article> and </article>, in h1 and p."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
