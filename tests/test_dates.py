"""Publication days from each source, and which source wins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from websheaf.functions import dates

#: html, url, day, source
PAGES = [
    ('<script type="application/ld+json">{"dateModified":"2024-05-05","datePublished": "2023-04-02T10:00:00Z"}</script>', None, "2023-04-02", "json-ld"),
    ('<script>{"datePublished":"2023-04-02"},{"dateCreated":"2022-01-01"}</script>', "https://x/2020/01/01/a", "2022-01-01", "json-ld"),
    ('<meta property="article:published_time" content="2021-02-03T00:00:00+02:00">', None, "2021-02-03", "meta"),
    ("<meta content='2021-02-04' name='date' />", None, "2021-02-04", "meta"),
    ("<META NAME=DC.date.issued content=2021-02-05>", None, "2021-02-05", "meta"),
    ('<meta name="date" content="2031-01-01"><time datetime="2019-01-02">x</time>', None, "2019-01-02", "time"),
    ('<time datetime="2018-01-01">a</time><time class="entry-date published" datetime="2019-07-08T1:1">b</time>', None, "2019-07-08", "time published"),
    ("<p>Posted 3 May 2001</p>", "https://x.example/news/2017/6/9/story-20160101", "2017-06-09", "url"),
    ("x", "https://x.example/a-2017-06-10-b.html?d=2001-01-01", "2017-06-10", "url"),
    ("x", "https://2017-06-10.example/12/13/14", None, None),
    ("<p>On 1 May 2001 it rained.</p><p>Published on <b>March 3rd, 2016</b> by me</p>", "u", "2016-03-03", "text published"),
    ("<div>Veröffentlicht</div><div>4. März 2015</div><p>5. Mai 2014</p>", None, "2015-03-04", "text published"),
    ("<p>It was 12 December 2012; later 2011-11-11, Jan. 5, 2013.</p><script>'1999-01-01'</script><!-- 1998-01-01 -->", None, "2011-11-11", "text"),
    ("<p>version 1.2012-12-12-3 and 2012-13-45 and 31 February 2012 and 1 May 1990</p>", None, None, None),
    ('<meta property="article:modified_time" content="2022-02-02">', "https://x", "2022-02-02", "modified"),
    ('<meta property="article:modified_time" content="2022-02-02"><p>3 Oktober 2021</p>', "https://x", "2021-10-03", "text"),
    ("", "", None, None),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, h, u) for i, (h, u, *_) in enumerate(PAGES)], "i int, html string, url string")
    out = rows.select("i", dates.publication_day(F.col("html"), F.col("url"), F.lit("2026-01-01").cast("date")).alias("d")).select("i", F.col("d.day").cast("string").alias("day"), "d.source")
    return {r.i: (r.day, r.source) for r in out.collect()}


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_page(found, i):
    assert found[i] == PAGES[i][2:]


def test_every_source_has_a_page():
    assert {p[3] for p in PAGES} - {None} == set(dates.SOURCES)


def test_latest_day_bounds_what_is_plausible(spark):
    rows = spark.createDataFrame([('<meta name="date" content="2024-06-01"><p>2 June 2024</p>', "u")], "html string, url string")
    day = lambda latest: rows.select(dates.publication_day(F.col("html"), F.col("url"), F.lit(latest).cast("date"))["day"].cast("string").alias("d")).first().d
    assert (day("2024-06-01"), day("2024-05-31")) == ("2024-06-01", None)
