"""Elements that are named like boilerplate but hold the article."""

import time

import pytest

from veilspark.llm import htmltext

ARTICLE = "<article><h1>Title</h1><p>The story of the day in some more words</article>"
TEXT = "Title\nThe story of the day in some more words"
REST = "<div class=sidebar><div class=widget><article>teaser</article></div></div><section id=comments><article>a reply</article></section>"


@pytest.mark.parametrize("html,want", [
    (f'<div>Site</div><div class="content-sidebar-wrap">{ARTICLE}{REST}</div>', TEXT),
    (f'<div class="no-sidebar">{ARTICLE}{REST}</div>', TEXT),
    (f'<div class="page has-sidebar">{ARTICLE}{REST}</div>', TEXT),
    (f'<div id="search-content"><main>{ARTICLE}{REST}</main></div>', TEXT),
    (f'<form id="aspnetForm"><nav>Home</nav>{ARTICLE}{REST}<footer>f</footer></form>', TEXT),
    (f'<main><h2>News</h2><div class="content-sidebar-wrap">{ARTICLE}{REST}</div></main>', TEXT),
    (f'<form><div class="sidebar-wrap"><div class="post">{TEXT.replace(chr(10), "<p>")}</div></div></form>', TEXT),
    (f'<div>{ARTICLE.replace("<article>", "<article class=&quot;post no-comments&quot;>").replace("&quot;", chr(34))}</div>', TEXT),
    (f"{ARTICLE}{REST}<section id=comments><article>{'a very long reply ' * 20}</article></section>", TEXT),
    (f"<div hidden><article>{'never shown ' * 20}</article></div>{ARTICLE}", TEXT),
    (f"<div class=post><p>Short</div><section id=comments><article>{'a very long reply ' * 20}</article></section>", "Short"),
])
def test_a_wrapper_keeps_its_article_and_nothing_else(html, want):
    assert htmltext.parse(html)[0] == want


def test_weak_signs_are_left_to_the_host():
    text, blocks = htmltext.parse('<article><p>One.<section id="search-results"><p>Two found.</section><p class="copyright-law">Law.<div class="related-work">Work.</div><div class="post-comments">Nice!</div><div class="relatedPosts">more</div></article>')
    assert text is None and [t for k, t in blocks if k == "w"] == ["Two found.", "Law.", "Work."] and [t for k, t in blocks if k == "d"] == ["Nice!", "more"]


@pytest.mark.parametrize("html", ["<div></span>" * 100_000, "<nav>" * 100_000 + "x", "<nav><article>" * 50_000 + "x", "<li><div>" * 50_000, "<span>" * 50_000 + "<hr>" * 50_000, "<p>" * 100_000, "<table><tr><td>" * 30_000])
def test_deep_pages_take_linear_time(html):
    at = time.process_time()
    htmltext.parse(html)
    assert time.process_time() - at < 4
