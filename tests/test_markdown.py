"""HTML to markdown on hand-written pages, selectors one by one, and scores against a recursive version."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from websheaf.functions import markdown as md
from websheaf.plans import markup

TESTS = tuple(map(md.Selector.of, md.CONSENT))

#: page, its raw markdown
PAGES = [
    ("<h1>A</h1><h3>B <em>c</em></h3>text", "# A\n\n### B _c_\n\ntext"),
    ("<p>one<p>two  \n three<div>four<p>five</div>six", "one\n\ntwo three\n\nfour\n\nfive\n\nsix"),
    ("a<br>b<br><br>c", "a  \nb  \n  \nc"),
    ("<a href=' /u '>l <b>k</b> </a>x<a>no</a><a href=/e> </a>", "[l **k**](/u) xno"),
    ("<p>a <b> bold </b><i></i>b</p>", "a **bold** b"),
    ("<img alt='x' src=/i.png><img>", "![x](/i.png)"),
    ("<ul><li>one<ul><li>in <b>ner</b><li>two</ul><li><p>para</p><p>second</p></ul>after", "* one\n  * in **ner**\n  * two\n* para\n  second\n\nafter"),
    ("<ol start=3><li>c<li>d<ol><li>e</ol></ol><ol><li>f</ol>", "3. c\n4. d\n  1. e\n\n1. f"),
    ("<pre><code class=x>x = 1\n  y &lt; 2</code></pre><p>`<code>a b</code>", "```\nx = 1\n  y < 2\n```\n\n``a b`"),
    ("<blockquote><p>q<p>r<blockquote>s</blockquote></blockquote>t", "> q\n\n> r\n\n> > s\n\nt"),
    ("<table><caption>cap</caption><tr><th>A<th>B<tr><td>1|2<td><p>x<p>y<tr><td>z</table>end", "| cap |  |\n| --- | --- |\n| A | B |\n| 1\\|2 | x y |\n| z |  |\n\nend"),
    ("<table><tr><td>a<tr><td>b</table>", "a\n\nb"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "| in ner | out |\n| --- | --- |"),
    ("a<hr>b", "a\n\n* * *\n\nb"),
    ("<script>var a = '<p>';</script><style>p</style>a<!-- b -->c<noscript>d</noscript>", "ac"),
    ("<head><title>t</title><p>body", "body"),
    ("<title>t</title>&amp;copy; &copy; &#8364; &nosuch;", "&copy; © € &nosuch;"),
    ("</p></div>a</b><unknown>b</unknown>", "ab"),
    ("<h2>a<br>b</h2>", "## a b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n\nd\n\nu\n\ne"),
    ("", ""),
    (None, ""),
    ("plain < text > & more", "plain < text > & more"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_raw(page, want):
    assert md.page_markdown(page, TESTS)[0] == want


@pytest.mark.parametrize("selector", md.CONSENT)
def test_each_consent_selector_removes_its_subtree(selector):
    s = md.Selector.of(selector)
    page = f"<p>before</p><div {s.attribute}='a-{s.value}-b'><p>accept <span>all</span><ul><li>x</ul></div><p>after"
    assert md.page_markdown(page, TESTS) == ("before\n\nafter", md.page_markdown("<p>before</p><p>after", TESTS)[1], 1)
    assert md.page_markdown(page, (s,))[2] == 1
    assert md.page_markdown(page.replace(s.value, s.value.swapcase()), (s,))[2] == 0


@pytest.mark.parametrize(
    "selector, tag, attributes, want",
    [
        ("[a]", "p", {"a": ""}, True), ("[a]", "p", {"b": "a"}, False), ("p[a='x']", "p", {"a": "x"}, True), ("p[a='x']", "div", {"a": "x"}, False), ("*[a=x]", "div", {"a": "x"}, True),
        ("[a^='x']", "p", {"a": "xy"}, True), ("[a^='x']", "p", {"a": "yx"}, False), ("[a$=\"x\"]", "p", {"a": "yx"}, True), ("[a~='x']", "p", {"a": "y x"}, True), ("[a~='x']", "p", {"a": "yx"}, False),
        ("[a|='x']", "p", {"a": "x-y"}, True), ("[a|='x']", "p", {"a": "xy"}, False), ("[a*='']", "p", {"a": "xy"}, False),
    ],
)
def test_selector_operators(selector, tag, attributes, want):
    assert md.Selector.of(selector).matches(tag, attributes) is want


def test_other_selectors_are_refused():
    for bad in ("div", ".a", "#a", "[a='b'] p", "[a!='b']"):
        with pytest.raises(ValueError):
            md.Selector.of(bad)


def test_fit_leaves_chrome_and_sparse_blocks_out():
    prose = "This is a sentence of an article that has enough words to count as prose. " * 3
    links = "".join(f"<a class='a very long class name indeed {i}' href='/a/long/address/{i}'>x{i}</a>" for i in range(9))
    page = f"<nav><p>{prose}</nav><div class='sidebar'>{links}</div><article><h1>Title of it</h1><p>{prose}<a href=/u>link</a></p><div class=promo><span data-x='{'y' * 90}'>ad</span><pre>code</pre></div></article><footer>{prose}</footer>"
    raw, fit, removed = md.page_markdown(page, TESTS)
    assert fit == f"# Title of it\n\n{prose}[link](/u)\n\n```\ncode\n```" and removed == 0
    assert "x1" in raw and raw.count("sentence") == 9


def recursive_scores(page):
    """Scores by a tree of lists and plain recursion; for pages whose tags are all closed."""

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = ["html", {}, [], 0]
            self.stack = [self.root]

        def handle_starttag(self, tag, attrs):
            node = [tag, dict(attrs), [], len(self.get_starttag_text())]
            self.stack[-1][2].append(node)
            self.stack.append(node)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            self.stack[-1][2].append(data)

    builder, found = Builder(), []
    builder.feed(page)
    builder.close()

    def visit(node):
        at = len(found)
        found.append(None)
        text = links = markup = 0
        for child in node[2]:
            if isinstance(child, str):
                found.append(("text", 0))
                text += len(re.sub(r"\s+", " ", child).strip())
                markup += len(child)
            else:
                t, k, m = visit(child)
                text, links, markup = text + t, links + (t if child[0] == "a" else k), markup + m
        markup += node[3] + len(node[0]) + 3
        own = text if node[0] == "a" else links
        names = f"{node[1].get('class', '')} {node[1].get('id', '')}"
        found[at] = (node[0], 0.4 * text / markup + 0.2 * (1 - own / text if text else 0) + 0.2 * md.TAG_WEIGHTS.get(node[0], 0.5) + 0.1 * (-0.5 if md.BAD_NAMES.search(names) else 0) + 0.1 * math.log(text + 1))
        return text, links, markup

    visit(builder.root)
    return found


def test_scores_match_the_recursive_version():
    page = "<div id=nav><ul><li><a href='/x'>one</a></li><li>two <b>three</b></li></ul></div><article class='x'>a  b<p>c <a href='y'>d <i>e</i></a></p><h2></h2></article>"
    tree = md.Tree(page)
    found = md._scores(tree, [True] * len(tree.tag))
    want = recursive_scores(page)
    assert len(found) == len(want)
    for i, (tag, score) in enumerate(want[1:], 1):
        if tag != "text":
            assert tree.tag[i] == tag and found[i] == pytest.approx(score)


def test_deep_nesting_takes_linear_time():
    depth = 60_000
    raw, fit, _ = md.page_markdown("<div>" * depth + "deep" + "<ul><li>" * 2_000 + "x", TESTS)
    assert "deep" in raw and raw.rstrip().endswith("* x")


def test_column(spark):
    df = spark.createDataFrame([(1, "<h1>A</h1><div id=onetrust>x</div>"), (2, None), (3, "")], "n int, html string")
    assert [tuple(r) for r in df.select("n", md.markdown(F.col("html")).alias("m")).select("n", "m.raw", "m.removed").orderBy("n").collect()] == [(1, "# A", 1), (2, "", 0), (3, "", 0)]
    assert df.select(md.markdown(F.col("html"), selectors=["h1[class]"]).alias("m")).first().m.removed == 0


def test_a_batch_is_written_slice_by_slice(spark):
    """A slice's pages, not a batch's, are in a worker at once; order, nulls and empty pages stay."""
    from websheaf.functions import text

    sizes = [0, 3, None, 400_000, 700_000, 2_500_000, 0, 10]
    texts = text.pa.array([None if n is None else "x" * n for n in sizes])
    parts = text.ranges(texts)
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes))) and len(parts) > 2
    assert all(sum(n or 0 for n in sizes[a + 1 : b]) <= text.SLICE for a, b in parts)  # a slice and one text more
    assert text.ranges(texts.slice(0, 0)) == []
    pages = [None, ""] + [f"<p>{i} " + "word " * (i % 7 * 3000) + "<p>end" for i in range(300)]
    found = spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1).select("i", md.markdown(F.col("html")).alias("m")).orderBy("i").collect()
    assert [(r.m.raw, r.m.fit, r.m.removed) for r in found] == [md.page_markdown(p, TESTS) for p in pages]


def test_notices_of_pages_without_html_or_article(spark, tmp_path):
    """As in the SQL: no row without html, and a notice that goes again on every other page."""
    path = str(tmp_path / "pages.parquet")
    pages = [(0, None), (1, ""), (2, '<nav><ul><li><a href="/a">b</a></li></ul></nav>'), (3, "<article><h1>A</h1><p><b>c<br></article>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(path)
    found = markup.QUERIES["c04_without_consent"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(markup.SQL["c04_without_consent"]).fetchall())
    assert [(r.page_id, r.raw, r.removed) for r in sorted(found)] == [(1, "", 1), (2, "* [b](/a)", 1), (3, "# A\n\n**c**", 1)]
