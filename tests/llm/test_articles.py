"""Articles in common page shapes come out whole."""

from __future__ import annotations

import pytest

from websheaf.llm import html_extract
from websheaf.llm.html_blocks import blocks

PROSE = [
    "The committee met on Tuesday to discuss the plan, which had been delayed twice, and it agreed to go on.",
    "Nobody expected the outcome to be so clear; still, a few members asked for more time to read the report.",
    "In the end the vote was taken, and the work will begin in spring, as the chair had hoped.",
]
HEADING = "Plan agreed after long debate"
CONTAINERS = [f'div class="{n}"' for n in ("post-body", "entry-content", "content", "article-body", "story", "s-prose js-post-body", "body", "markdown-body", "post", "mw-parser-output", "text", "rich-text", "page")] + ["div", "section", "main", "article"]


def page(container, tag):
    menu = '<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></div>'
    inner = f"<h1>{HEADING}</h1>" + "".join(f"<{tag}>{x}</{tag}>" for x in PROSE)
    return f'<html><body>{menu}<{container}>{inner}</{container.split()[0]}><div class="footer">© 2024 The Paper. All rights reserved.</div></body></html>'


@pytest.mark.parametrize("container", CONTAINERS)
@pytest.mark.parametrize("tag", ["p", "div"])
def test_articles_are_whole(container, tag):
    model = html_extract.trained()
    assert model.content([model.blocks(page(container, tag))]) == [[HEADING, *PROSE]]


def test_a_blog_page_without_notice_menu_and_comments():
    model = html_extract.trained()
    html = (
        '<html><body><div id="cookie-banner">We use cookies. <button>OK</button></div><div class="nav"><a href=/>Home</a> <a href=/x>Posts</a></div><div class="post"><h1>My trip</h1>'
        + "".join(f"<div>{x}</div>" for x in PROSE)
        + '</div><div class="comments"><h3>2 comments</h3><div class="comment"><p>Great post, thank you for writing it!</p></div><div class="comment"><p>I was there too, and it was fun.</p></div></div><footer>© me</footer></body></html>'
    )
    assert model.content([model.blocks(html)]) == [["My trip", *PROSE]]


@pytest.mark.parametrize("depth", [0, 1, 3, 40])
def test_link_text_counts_at_any_depth(depth):
    found = blocks("<a href=/>" + "<span>" * depth + "menu text here." + "</span>" * depth + "</a> out")
    assert [(b.text, b.linked) for b in found] == [("menu text here. out", 15)]


def test_long_pages_are_parsed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SLICE", 1000)
    rows = [(i, "u", page("article", "p") if i % 3 else None) for i in range(30)]
    found = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), html_extract.trained()).collect()
    assert {r.page_id: r.text for r in found} == {i: "\n\n".join([HEADING, *PROSE]) if h else "" for i, _, h in rows}
