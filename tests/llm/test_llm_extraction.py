import html
import re
import tracemalloc

import pytest

from repostrata.llm import extraction, html_blocks

PAGES = "page_id long, url string, html string, host string, salt int"


def text_of(source):
    page = html_blocks.read(source)
    best = html_blocks.scores(page)
    return html_blocks.extract(page, best[0][0]) if best else "\n".join(b[1] for b in page.blocks)


def test_boilerplate_and_markup_are_left_out():
    source = (
        '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav>'
        '<div class="cookie-notice">We use cookies</div><div id="post-12" class="entry post-12"><h1>A &amp; B</h1>'
        '<p>One  two\n<b>three</b><br>four<!-- no --><p>five <a href="/x">six</a><ul><li>seven<li>eight</ul>'
        '<form><input>search</form><script>if (a<b) "</p>"</script><div class="comments"><p>first!</div></div>'
        '<aside>more</aside><footer>&copy; me</footer></body></html>'
    )
    assert text_of(source) == "A & B\nOne two three\nfour\nfive six\nseven\neight"


def test_broken_pages():
    assert text_of("") == ""
    assert text_of("just a < b text") == "just a < b text"
    assert text_of("<article><p>cut off <b>her") == "cut off her"
    assert text_of('<article><p title="a>b">x</p></div></article><p>y') == "x"
    assert text_of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text_of("<div><script>never closed <p>x") == ""


def test_paths_generalise_numbers():
    assert html_blocks.step("div", ' class="post-17 b a9"') == "div.a#.b.post-#"


def test_host_consensus_decides(spark):
    good = '<body><div class="story"><p>{}</p></div><div class="box"><p>{}</p></div></body>'
    rows = [(i, "http://h.example.com/%d" % i, good.format("main text " * 20, "extra"), "x", 1) for i in range(6)]
    odd = (9, "https://H.example.com:80/odd", good.format("short", "a longer box than the story " * 5), "x", 1)
    lone = (10, None, good.format("short", "a longer box than the story " * 5), "x", 1)
    rows += [odd, lone, (11, "bad url", None, "x", 1), (11, "bad url", None, "x", 1), (None, "http://h.example.com", "", "x", 1)]
    got = extraction.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[9] == "short" and texts[10].startswith("a longer box") and texts[11] == "" and texts[None] == ""
    assert extraction.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_whole_table_gives_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)
        parts = re.split(r"</?(?:p|br|h1)>", article[1])
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)
        assert got[page.page_id] == "\n".join(line for line in lines if line)


def test_layout_classes_do_not_hide_the_page():
    for source in (
        '<body class="right-sidebar"><article><p>whole text</article></body>',
        '<body class="has-sidebar"><div><p>whole text</div></body>',
        '<body><main class="no-sidebar"><p>whole text</main></body>',
        '<body><article class="no-comments"><p>whole text</article></body>',
        '<body><div class="promo-story"><p>whole text</div></body>',
        '<body><article><figure><img><figcaption>whole text</figcaption></figure></article></body>',
    ):
        assert text_of(source) == "whole text"
    assert text_of('<article><p>text</p><div class="sidebar">x</div></article>') == "text"


def test_sibling_sections_and_other_templates_are_kept(spark):
    lead, text = "lead words " * 27, "body text words " * 190
    wide = f"<body><main><div class=wrap><div class=lead><p>{lead}</div><div class=text><p>{text}</div></div></main></body>"
    soup = f"<body><div class=lead><p>{lead}</div><div class=text><p>{text}</div><div class=foot><p>short</div></body>"
    other = f"<body><div class=text><p>a teaser</div><div class=review><p>{text}</div></body>"
    rows = [(i, "http://wide.example.com/", wide, "x", 1) for i in range(4)]
    rows += [(10 + i, "http://soup.example.com/", soup, "x", 1) for i in range(9)] + [(20, "http://soup.example.com/", other, "x", 1)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == got[10] == f"{lead.strip()}\n{text.strip()}"
    assert got[20] == f"a teaser\n{text.strip()}"


@pytest.mark.parametrize("kept", [
    '<article><h2 class="banner-title">{}</h2></article>', '<article><p id="search-and-rescue">{}</p></article>',
    '<article><div class="ad-hoc-network">{}</div></article>', '<article><p class="notice-period">{}</p></article>',
    "<body><div><figure><figcaption>{}</figcaption></figure></div></body>", "<article><p><math><mi>{}</mi></math></p></article>",
    "<article><p><label>{}</label></p></article>", '<div class="comment-on-law"><p>{}</p></div>', '<div class="share-price">{}</div>',
    '<div class="promo-story"><p id="footer-of-a-mountain">{}</p></div>',
])
def test_names_of_subjects_are_no_boilerplate(kept):
    page = html_blocks.read(kept.format("Whole text of it"))
    assert [b[1] for b in page.blocks] == ["Whole text of it"]


@pytest.mark.parametrize("gone", [
    '<div class="comment-list">{}</div>', '<div id="site-footer">{}</div>', '<ul class="nav-menu"><li>{}</ul>', '<p class="ad">{}</p>',
    '<div class="cookie-banner">{}</div>', '<section class="related-posts"><p>{}</section>', '<div class="sidebar-2">{}</div>',
    "<form><label>{}</label></form>", '<div role="navigation">{}</div>', '<div class="newsletter-signup-box">{}</div>',
    "<article><math><annotation>{}</annotation></math></article>",
])
def test_names_of_page_parts_are(gone):
    page = html_blocks.read(f"<body><article><p>The article.</p></article>{gone.format('Not of it')}</body>")
    assert [b[1] for b in page.blocks] == ["The article."]


def test_memory_follows_the_size_of_a_page_not_its_depth():
    source = "<div class='level'>" * 20_000 + "text" + "</div>" * 20_000
    tracemalloc.start()
    try:
        page = html_blocks.read(source)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [b[1] for b in page.blocks] == ["text"] and peak < 60_000_000
    assert len({p for p, _ in page.containers}) == 20_000
