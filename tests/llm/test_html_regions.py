from graphloom.llm.html_extract import main_text

LONG = "A sentence of the page that is long enough to count as prose, with words and more words. " * 3
LINKS = "<div>" + "".join(f"<a href={i}><b>x{i}</b></a> " for i in range(12)) + "</div>"


def test_long_text_beside_a_teaser_is_kept():
    teaser = "<article><h3><a href=1><b>Read</b></a></h3></article>"
    page = f"<body>{LINKS}{teaser}{LINKS}<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>{LINKS}</body>"
    assert main_text(page) == "\n".join(["Head", LONG.strip(), LONG.strip()])


def test_content_beside_an_article_is_kept():
    page = f"<body>{LINKS}<article><h1>One</h1><p>{LONG}</p></article>{LINKS}{LINKS}<div><p>{LONG}Two.</p></div>{LINKS}</body>"
    assert main_text(page) == "\n".join(["One", LONG.strip(), LONG + "Two."])


def test_an_article_of_links_does_not_pass_for_one_long_line():
    links = "".join(f"<p><a href={i}><b><i>x{i}</i></b></a></p>" for i in range(90))
    page = f"<body><article>{links}<section><p>{LONG}</p></section></article></body>"
    assert main_text(page) == LONG.strip()


def test_marks_of_two_words_however_they_are_joined():
    for name in ("user-comments", "user_comments", "usercomments", "Comment-List", "ad-slot", "site-footer"):
        assert main_text(f'<main><p>{LONG}</p><div class="x {name}"><p>{LONG}</p></div></main>') == LONG.strip()
    for name in ("ad-hoc", "foot-care", "comment-on-lists", "user-comments-policy"):
        assert main_text(f'<main><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></main>') == f"{LONG.strip()}\n{LONG.strip()}"
