import pytest

from clearcharge.llm.html_text import extract, main_text

CHROME = "<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class='ad'>Buy now</div>"
FOOT = "<footer>&copy; all rights</footer>"
LONG = "A sentence that goes on for a while, with commas, and says something plain. " * 4


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"),
    (f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body>{CHROME}<article><h1>Head</h1><p>One&nbsp;two\n three<p>Four <b>five</b><br>six</article>{FOOT}", "Head\nOne two three\nFour five six"),
    (f"<body>{CHROME}<div id=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div><div id='sidebar'><a href=x>link</a> <a href=y>link</a></div>{FOOT}</body>", f"Head\n{LONG.strip()}\n{LONG.strip()}\none\ntwo"),
    (f"<main><p>{LONG}</p><section class='comments'><p>First!</p></section><form><input><p>Name</p></form><div class='cookie-notice'>We use cookies</div></main>", LONG.strip()),
    (f"<body><div id=pageHeader class=header><p>{LONG}</p></div><div class=wrap><div class=text><h1>Head</h1><div class=part><p>{LONG}</p><p>{LONG}</p></div><div class=part><p>{LONG}</p></div></div><div class=readerComments><p>{LONG}</p></div></div>{FOOT}</body>", "\n".join(["Head", *[LONG.strip()] * 3])),
    ("<article><header><h1>Own head</h1></header><p>Body</p></article><header>Site</header>", "Own head\nBody"),
    ("<p>a</p></div></p><p>b</span>c", "a\nbc"),
    ("<article><p>1 &lt; 2 &#233; &eacute; &notit; &#x65E5;</p><!-- hidden --><p class=leadership>kept</p></article>", "1 < 2 é é ¬it; 日\nkept"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ("<body>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é x</p>", 0), (2, None, None, 0), (1, "u", "<p>é x</p>", 0)], "page_id bigint, url string, html string, text int")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == [(1, "u", "é x", 3), (1, "u", "é x", 3), (2, None, "", 0)]
    assert extract(pages.limit(0)).count() == 0


def test_nothing_is_cut():
    text = "\n".join(f"Paragraph {i} holds its own words, {i * 7}." for i in range(4_000))
    page = f"<html><body>{CHROME}<article>" + "".join(f"<p>{t}</p>" for t in text.split("\n")) + f"</article>{FOOT}</body></html>"
    assert main_text(page) == text


@pytest.mark.parametrize("page,want", [
    (f"<article><h1><a href=/t>Title</a></h1><p>{LONG}</p><h2><a href='#x'>Section</a></h2><p>{LONG}</p><p><a href=s>Source</a></p><ul><li><a href=r>Reference</a></li><li><a href=q>Other</a></li></ul></article>", ["Title", LONG.strip(), "Section", LONG.strip(), "Source", "Reference", "Other"]),
    (f"<body><div class=text><div><h1><a href=/t>Title</a></h1></div><p>{LONG}</p><p>{LONG}</p><div><a href=1>one</a> <a href=2>two</a></div></div></body>", ["Title", LONG.strip(), LONG.strip()]),
    (f"<body><main><h1>Head</h1><article><p>{LONG}</p><p>{LONG}</p></article><article><p>More</p></article></main></body>", ["Head", LONG.strip(), LONG.strip(), "More"]),
    (f"<body>{CHROME}<article><p>{LONG}</p><p>{LONG}</p></article><article><p>More</p></article>{FOOT}</body>", [LONG.strip(), LONG.strip(), "More"]),
    (f"<body><main><article><p>{LONG}</p></article><div><a href=1>one</a> <a href=2>two</a></div></main></body>", [LONG.strip()]),
])
def test_linked_blocks_and_further_articles_stay(page, want):
    assert main_text(page) == "\n".join(want)


@pytest.mark.parametrize("name", ["elementor-widget elementor-widget-text", "content with-sidebar", "no-sidebar", "page-nav-open", "social-science", "share-article", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_do_not_remove_the_main_text(name, tag):
    page = f"<body>{CHROME}<div class='{name}'><{tag}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></{tag}></div><div class='related-posts'><a href=a>One</a> <a href=b>Two</a></div>{FOOT}</body>"
    assert main_text(page) == "\n".join(["Head", LONG.strip(), LONG.strip()])


def test_names_still_remove_the_rest():
    small = "<div class='ad-slot'><p>Buy this thing now.</p></div>"
    assert main_text(f"<body><div id=x><h1>Head</h1><p>{LONG}</p>{small}<p>{LONG}</p></div></body>") == "\n".join(["Head", LONG.strip(), LONG.strip()])
    assert main_text(f"<body><div class=ad>Much longer than the article is.</div><article><p>Few.</p></article></body>") == "Few."
    assert main_text(f"<body><div class=text><h1>Head</h1><p>{LONG}</p></div><div class=comments><p>{LONG * 3}</p></div></body>") == f"Head\n{LONG.strip()}"
    assert main_text("<body><div class='share-article'><a href=x>Only a link</a></div></body>") == "Only a link"
