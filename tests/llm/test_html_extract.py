from graphloom.llm.html_extract import extract, main_text, smooth

LONG = "A sentence of the article that is long enough to count as prose, with words and more words. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy &amp; go</div>
<article class="post"><header><h1>Head&nbsp;line</h1></header><p><b>{LONG}<br><p>Short.</p><aside>No</aside><div class="cookie-notice">No</div>
<p>Fish &amp; chips &#233; <a href="x">link</a>
 end</p><form><input><label>No</label></form><section id="comments"><p>{LONG}No</p></section></article>
<div id="sidebar">No</div><footer>&copy; No</footer></body></html>"""
TEXT = "\n".join(["Head line", LONG.strip(), "Short.", "Fish & chips é link end"])


def test_article():
    assert main_text(PAGE) == TEXT


def test_without_an_article_the_dense_container_is_text():
    page = f"<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div id=x><h2>Head</h2><p>{LONG}</p><p>Yes.</p></div><div><a>c</a></div></body>"
    assert main_text(page) == "\n".join(["Head", LONG.strip(), "Yes."])


def test_marked_parts_inside_an_article():
    for mark in ('class="commentlist"', 'id="user-comments"', 'role="navigation"', 'class="AdSlot"', "hidden", 'style="display: none"', 'aria-hidden="true"'):
        assert main_text(f"<main><p>{LONG}</p><div {mark}><p>{LONG}</p></div><p>End.</p></main>") == LONG.strip() + "\nEnd."
    assert main_text(f'<main><div class="padding additional"><p>{LONG}</p></div></main>') == LONG.strip()


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>cut off <") == "cut off <"
    assert main_text("<article>" + "<p>x y</p>" * 3) == "x y\nx y\nx y"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert main_text(deep) == "deep"
    assert len(main_text("<article><p>" + "word " * 400_000)) == 1_999_999


def test_smoothing_keeps_constants():
    assert [round(x, 9) for x in smooth([2.0] * 5)] == [2.0] * 5 and smooth([]) == []


def test_tables(spark):
    pages = spark.createDataFrame([(1, None, PAGE), (1, "u", None), (None, "u", "")], "page_id long, text string, html string")
    got = {(r[0], r[1], r[2]) for r in extract(pages, ["page_id", "text"]).collect()}
    assert got == {(1, None, TEXT), (1, "u", ""), (None, "u", "")}
    assert extract(pages.limit(0), ["page_id"]).count() == 0
