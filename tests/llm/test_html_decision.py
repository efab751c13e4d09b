"""The ratios' part in op1, implied end tags, and the time of pages that leave everything open."""

import math
import random
import time

import pytest

from graphloom.llm import html_extract as H
from graphloom.llm import registry

LONG = "A sentence of the page that is long enough to count as prose, with words and more words. " * 3
LINKS = "<div>" + "".join(f"<a href={i}><b>x{i}</b></a> " for i in range(12)) + "</div>"


def by_definition(values, sigma):
    """Gaussian smoothing and its clusters, written out."""
    reach = math.ceil(3 * sigma)
    out = []
    for i in range(len(values)):
        near = [(math.exp(-((i - j) ** 2) / (2 * sigma**2)), values[j]) for j in range(len(values)) if abs(i - j) <= reach]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    mean = sum(out) / len(out)
    return out, mean, H.THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in out) / len(out))


def test_smoothing_and_clusters_by_definition():
    rng = random.Random(4)
    for _ in range(60):
        lines = [H.Line("x" * rng.choice([1, 5, 90, 400]), rng.randrange(6), 0, 0, 0) for _ in range(rng.randrange(1, 30))]
        want, mean, limit = by_definition([len(x.text) / max(1, x.tags) for x in lines], H.SIGMA)
        got_limit, got_mean, above = H.clusters(lines)
        assert got_limit == pytest.approx(limit) and got_mean == pytest.approx(mean)
        assert [a for a, w in zip(above, want, strict=True) if abs(w - limit) > 1e-9] == [w >= limit for w in want if abs(w - limit) > 1e-9]


def test_without_articles_and_marks_the_ratios_choose(monkeypatch):
    page = f"<body>{LINKS}<div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{LINKS}{LINKS}</body>"
    assert H.main_text(page) == "\n".join(["Head", LONG.strip(), "Short.", LONG.strip()])
    monkeypatch.setattr(H, "THRESHOLD", -100)
    assert H.main_text(page).startswith("x0 x1")
    monkeypatch.setattr(H, "THRESHOLD", 50)
    assert H.main_text(page).startswith("x0 x1")  # nothing passes: text throughout


def test_ratios_alone_choose_the_article(monkeypatch):
    for name in ("MARKS", "WEAK_MARKS", "PAGE_MARKS", "NEVER"):
        monkeypatch.setattr(H, name, frozenset())
    page = f"<body><nav>{LINKS}</nav><div class=ad><a href=1><i>Buy</i></a></div>{LINKS}<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article>{LINKS}{LINKS}</body>"
    assert H.main_text(page) == "\n".join(["Head", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p class="ad">Buy<p>Real text.</article>', "Real text."),
        ('<ul><li class="ad">Buy<li>Real item</ul>', "Real item"),
        ('<div><p class="ad">Two<p>Three<p>Four</div>', "Three\nFour"),
        ('<table><tr><td class="promo">x<td>Cell<tr><td>Next</table>', "Cell\nNext"),
        ('<dl><dt class="ad">a<dd>b<dt>c</dl>', "b\nc"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
        ('<div><p class="ad">a<table><tr><td>b</table><p>c</div>', "b\nc"),
        ("<article><b><p>one</b> two</p></article>", "one two"),
        ('<div>a<span class="ad">b<p>c</div><div>d</div>', "a\nd"),
    ],
)
def test_end_tags_that_pages_omit(page, text):
    assert H.main_text(page) == text


def test_words_of_prose_need_the_ratio():
    body = f'<p>{LONG}</p><div class="related-work"><p>{LONG}</p></div><div id="share-prices"><p>{LONG}</p></div>'
    links = '<div class="related"><a href=1>a</a><a href=2>b</a></div><div class="share">Share <a>x</a> <a>y</a></div>'
    assert H.main_text(f"<article>{body}{links}</article>") == "\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize("piece", ["<span class=x>y", "<p><b class=x>y", "<div>x", "<span class=x>a<i class=y>b</span>", "<li class=q>x", "<table><tr><td>x", "<div class=related>x"])
def test_a_megabyte_of_open_elements(piece):
    def seconds(size):
        page = piece * (size // len(piece))
        began = time.process_time()
        H.main_text(page)
        H.main_text(page + "</b></i></p>" * 1000)
        return time.process_time() - began

    # Four times the page takes some four times as long on any machine; a quadratic fold takes 16 times.
    assert seconds(1 << 20) < 9 * min(seconds(1 << 18), seconds(1 << 18)) + 0.5


@pytest.mark.parametrize("name", ["notice-of-meeting", "flood-alert", "foot-care", "promotion-race", "comment-on-budget", "copyright-reform", "menu-of-the-day", "ad-hoc", "adHocReport"])
def test_a_name_that_holds_a_mark_needs_the_ratio(name):
    body = f'<section class="{name}"><p>{LONG}</p><p>{LONG}</p></section>'
    links = f'<div class="{name}"><a href=1>a</a><a href=2>b</a></div>'
    assert H.main_text(f"<article><h1>Head</h1>{body}{links}<p>{LONG}</p></article>") == "\n".join(["Head", *[LONG.strip()] * 3])


@pytest.mark.parametrize("name", ["ad", "Comments", "big sidebar", "cookie left"])
def test_a_name_that_is_a_mark_is_enough(name):
    assert H.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></article>') == LONG.strip()


def test_query_columns(spark, tmp_path):
    rows = [(1, "u", f"<article><p>{LONG}</article>"), (2, None, None), (2, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.op1_html_extract(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "u", LONG.strip(), len(LONG.strip())), (2, None, "", 0), (2, None, "", 0)], key=str)
