"""The rule sets of documentation sites on hand-written pages."""

from __future__ import annotations

import pytest

from websheaf.functions import sites

SOURCE = "<!-- source: https://a/b -->"

#: site, page, what stays of it
PAGES = [
    ("footer/metasearch", f"{SOURCE}\n\nnav\n# T [docs][](http://x)\ntext\nCopy page\n\n\n\nmore\n[ ![Logo of X](a)](b)\nfoot", f"{SOURCE}\n\n\n# T text\n\nmore\n"),
    ("footer/anthropic", f"{SOURCE}\n# T\na\nWas this page helpful?\nb\n### Solutions\nc", f"{SOURCE}\n\n# T\na\n"),
    ("footer/crawl4ai", "no title\n  ESC to close\nESC to close  \nx", "no title\n  ESC to close\n"),
    ("footer/playwright", "# T\n[Previouss](a)\n[Previous Page](b)", "# T\n[Previouss](a)\n"),
    ("footer/tor", "# T\nx\n[Edit this page](u)\ny", "# T\nx\n"),
    ("footer/onetrust", "# T\nGetting Started now\nGetting Started\ny", "# T\nGetting Started now\n"),
    ("footer/cookieyes", "## CookieYes\nx\n# T\nx\n## CookieYes\ny", "# T\nx\n"),
    ("footer/trafilatura", "# T\nx\n© Copyright 2024, y", "# T\nx\n"),
    ("footer/other", "# T\nx © 2024\n© 2024 y", "# T\nx © 2024\n"),
    ("tor", f"{SOURCE}\n\n\n# T\nView for: \nWindows\nbody\nExpand all Collapse all\nmore\n\n  * [Jobs](https://www.torproject.org/de/about/jobs/)\nfoot", f"{SOURCE}\n\n\n# T\nbody\nmore\n"),
    ("tor", "View for:\nView for:\nx\nView for: y", "x\nView for: y\n"),
    ("onetrust", f"{SOURCE}\n\n\nnav\n# T\n\n\n## \n\nName here \n[](https://d/#x)\n3 of 9[](u)\ntext\n## \n# Next\n* * *\n[p](u)[n](v)\n\n", f"{SOURCE}\n\n# T\n\n## Name here\ntext\n# Next\n"),
    ("onetrust", "a\n\n\n\n## \n\n\n\nb\n* * *\n\n---\n* * *\n", "a\n\n## b\n* * *\n"),
    ("onetrust", f"{SOURCE}\nno heading", f"{SOURCE}\n"),
    ("onetrust", "a\n[p](u)[n](v)", "a\n"),
    ("cookieyes", f"{SOURCE}\n\n\n# T\nSearch for:Search Button\n[Help Guides](x) > [C](y) > P\nbody\n![skip icon](a/skip.svg)\nJump to\n[A](u#x)\n[B](u#y)\nmore\n## Related articles\n* l\n## After\nx Was this article helpful? Yes No\nfoot", f"{SOURCE}\n# T\nbody\nmore\n## After\nx\n"),
    ("cookieyes", f"{SOURCE}\n# T\n![skip icon](a/skip.svg)\nkept\n[A](u#x)\n![](g2-badges)\n## Subscribe to get a monthly letter\nx\n## More\ny", f"{SOURCE}\n# T\nkept\n[A](u#x)\n"),
    ("cookieyes", "Search for:Search Button\n## Related articles\nWas this article helpful?\nx", "Search for:Search Button\n"),
    ("anthropic", f"{SOURCE}\n\n\n\n# \nTitle\ntext\n### \n\nx\n## \n# y\n[ a ](https://x)[ b ](https://y)\n\n[ c ](https://x)[ d ](https://y)", f"{SOURCE}\n\n# Title\ntext\n### \n\nx\n## \n# y\n"),
    ("anthropic", "text\n\n\nmore\n[ a ](https://x)", "text\n\n\nmore\n[ a ](https://x)\n"),
    ("playwright", f"nav\n{SOURCE}\n# T\nbody\nLearn\n\n  * [x](y)\nfoot", f"{SOURCE}\n\n# T\nbody\n"),
    ("playwright", f"{SOURCE}\n# T\nMore\ntext\n[Next up](u)\nfoot", f"{SOURCE}\n\n# T\nMore\ntext\n"),
    ("playwright", "## no title\r\nx  ", "## no title\r\nx  "),
    ("docs/playwright", f'{SOURCE}\nnav\n## T[​](u#t "Direct link to T")\nbody\n[Previous a](u)', f"{SOURCE}\n\n## T\nbody\n"),
    ("docs/crawl4ai", f"{SOURCE}\n# Old\n[Crawl4AI Documentation (v)](u)\n* a\n# T\n```\nx\n```\nCopy\nend\n#### On this page\nz", f"{SOURCE}\n\n# T\n```\nx\n```\nend\n"),
    ("docs/crawl4ai", "[Crawl4AI Documentation (v)](u)\n* a\n\n[b](c)\n×\nfirst\n- item\nxClose\nz", "first\n- item\n"),
    ("docs/trafilatura", f'{SOURCE}\n## T[#](u#t "Link to this heading")\nbody\n\n[ previous a ][ next b ]\nz', f"{SOURCE}\n\n## T\nbody\n"),
    ("unknown", "a\r\nb", "a\r\nb"),
    ("tor", None, None),
    ("tor", "", "\n"),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(i, site, text, i) for i, (site, text, _) in enumerate(PAGES)], "n int, site string, text string, start int")
    return {r.n: r.text for r in sites.cleaned(pages, sites.rule_table(spark)).collect()}


@pytest.mark.parametrize("n", range(len(PAGES)))
def test_page(found, n):
    assert found[n] == PAGES[n][2]


def test_every_rule_set_has_a_page():
    assert set(sites.SITES) <= {site for site, *_ in PAGES}


def test_long_pages_keep_their_state_over_blocks(spark):
    body = [f"line {i}" for i in range(5 * sites.BLOCK)]
    page = ["# T", "## Related articles", *body, "## After", *body]
    df = spark.createDataFrame([("cookieyes", "<!-- source: x -->\n" + "\n".join(page))], "site string, text string")
    assert sites.cleaned(df, sites.rule_table(spark)).first().text == "\n".join(["<!-- source: x -->", "# T", "## After", *body]) + "\n"


def test_a_new_site_is_a_new_row(spark):
    rules = sites.rule_table(spark, {"mine": sites.Site(rules=(sites.Rule("body", "AD"), sites.Rule("body", r"(\w+)!+[\s\S]*", "turned", text="$1.")))})
    df = spark.createDataFrame([("mine", "a\nAD x\nb!!\nc"), ("tor", "AD")], "site string, text string")
    assert sorted(r.text for r in sites.cleaned(df, rules).collect()) == ["AD", "a\nb.\nc\n"]
