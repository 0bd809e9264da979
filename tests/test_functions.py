"""Text, page and quantile functions on hand-written rows, and against plain Python."""

from __future__ import annotations

import html
import re
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from websheaf.functions import cleaners, pages, text, urls
from websheaf.operators import fusion, ingest, ordered, quantiles, ranking
from websheaf.plans import text as plans


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("o", f(F.col("v")))
    return [r.o for r in rows.orderBy("i").collect()]


def test_truncate(spark):
    long = "word " * 200
    stop = "a" * 449 + ". " + "b " * 100
    found = column(spark, text.truncate, ["short", stop, long, "x" * 1000, "a. " + "b" * 600])
    assert found[0] == "short" and found[1] == "a" * 449 + "." and found[2] == ("word " * 100)[:499] + "…" and found[3] == "x" * 500 + "…" and found[4] == "a.…"


def test_strip_bloat(spark):
    cases = {"Web results Title": "Title", "Some text Read more at": "Some text", "12 answers · asked": "", "a › b text": "a b text", "&amp;lt; x": "x", " · Translate this page rest": "rest", "Tail Tagged with a, b.": "Tail", "<b>x</b>  y": "x y"}
    assert column(spark, text.strip_bloat, list(cases)) == [" ".join(v.split()) if k != "a › b text" else "a b text" for k, v in cases.items()]


def plain_cut(t):
    best = 0
    for n in (100, 70, 50, 30):
        for i in range(0, 100):
            piece = t[:300][i : i + n]
            if len(t[:300]) >= 2 * n and i < len(t[:300]) - 2 * n and (j := t[:300].find(piece, i + n)) > 0:
                best = max(best, j + n)
    return best if len(t) >= 60 else 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=60), st.text("abc ", max_size=200))
def test_doubled_beginnings(head, tail):
    assert text.doubled_cut(head + head + tail) == plain_cut(head + head + tail)


def test_heads_alone_go_to_python(spark):
    line = "An ünusual \U0001f600 beginning of thirty characters and more. "
    values = [None, "", "short", line, line * 2 + "rest", line * 3, line + "x" * 400 + line, line[:30] * 2, "é" * 700]
    assert column(spark, text.without_doubled, values) == [v if v is None else v[plain_cut(v) :] for v in values]
    plan = spark.createDataFrame([("x",)], "v string").select(text.without_doubled(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "left(" in plan.split("ArrowEvalPython", 1)[1].lower() or "substring(" in plan.split("ArrowEvalPython", 1)[1]


def test_unescape(spark):
    values = ["&amp;amp;lt;", "&copy 1 &#65;&unknown;", None]
    assert column(spark, text.unescape, values) == [html.unescape(v) if v else None for v in values]
    assert column(spark, text.unescape_all, values)[0] == "<"


def test_epoch_days_of_far_years(spark):
    seconds = [0, 86_399, -1, 419_000 * 7 * 86_400, 60_000_000 * 7 * 86_400, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(seconds)], "i int, v long").select("i", text.epoch_day(F.col("v")).alias("o"))
    assert [r.o for r in rows.orderBy("i").collect()] == ["1970-01-01", "1970-01-01", "1969-12-31", "10000-04-13", "1151890-12-11", None]


def test_references_alone_go_to_python(spark):
    values = [
        "plain", "", None, "&", "&&amp;", "a&lt", "&notit; &notin; &#10;x&#xA;y&NewLine;z", "&#0;&#x110000;&#xD800;&#128;&#999999999999;", "&" + "x" * 40 + ";", "\r&a\rb;&amp\r", "&é;&ü", "&amp;" * 5000 + "é\U0001f600&euro;",
        "end&", "&;&#;&#x;&#xg;", "x &copy y&copyz; &AMP;&Amp;", "&CounterClockwiseContourIntegral;&\x0blt;",
    ]
    assert column(spark, text.unescape, values) == [v if v is None else html.unescape(v) for v in values]
    assert column(spark, text.unescape_all, ["&" + "amp;" * 40 + "lt;", None, "", "a"]) == ["<", None, "", "a"]
    plan = spark.createDataFrame([("x",)], "v string").select(text.unescape(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan.split("ArrowEvalPython", 1)[1]


def test_inverted_index_inside_the_row(spark):
    texts = ["b a b c a b", "", "one", None, " x  x ", "w " * 3000 + "z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = frame.select("doc_id", text.inverted_index(F.split("text", r"\s+")).alias("x"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, v in enumerate(texts):
        places = {}
        for at, w in enumerate(re.split(r"\s+", v) if v is not None else ()):
            places.setdefault(w, []).append(at)
        want[i] = None if v is None else places
    assert {r.doc_id: r.x for r in rows.collect()} == want
    back = frame.select("doc_id", text.abstract(text.inverted_index(F.split("text", r"\s+"))).alias("x"))
    assert {r.doc_id: r.x for r in back.collect()} == {i: v if v is None else re.sub(r"\s+", " ", v) for i, v in enumerate(texts)}
    assert spark.range(1).select(text.abstract(F.expr("map('b', array(1, 0), 'a', array(1, 2))")).alias("x")).first().x == "b b a"


def test_abstracts_need_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plans.QUERIES["t16_abstract"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def plain_feed(md):
    ls = md.splitlines()
    start = next((i for i, x in enumerate(ls) if x.startswith("# ")), None)
    if start is None:
        return md.strip()
    end = next((i for i in range(start + 1, len(ls)) if any(re.search(p, ls[i]) for p in pages.FEED_ENDS)), len(ls))
    kept = [x for x in ls[start:end] if not any(re.search(p, x) for p in pages.FEED_DROPS)]
    kept = [re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", re.sub(r"\[\]\(.*?\)", "", x)).rstrip(" \t") for x in kept]
    out = []
    for x in kept:
        body = bool(x.strip()) and not x.lstrip().startswith(("#", "*", "-"))
        if not x.strip():
            if out and out[-1] != "":
                out.append("")
            continue
        if body and out and out[-1] != "" and not out[-1].lstrip().startswith(("#", "*", "-")):
            out.append("")
        out.append(x)
    return "\n".join(out).strip("\n")


def test_feed_clean(spark):
    bodies = [
        "nav\n# Title\nBy [A](b)\nMay 5, 2024, 3 min read\npara one [link](u)  \npara two\n\n\n* item\n- item\npara\n![i](j)\n[t](u)\n[a](b)[c](d)\nMore For You\nrest",
        "# T\n## H\np\np\n## More For You\nq", "no heading\n here ", "# only", "",
    ]
    assert column(spark, pages.feed_clean, bodies) == [plain_feed(b) for b in bodies]


def computed(column):
    """How often a column's expression splits a text into lines."""
    return str(column).count(f"split({'v'},")


def test_white_space_of_every_kind(spark):
    """strip() and squeezed() know the same characters as the regular expressions of Unicode white space."""
    points = [i for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(chr(i),) for i in points], "c string")
    word = F.concat("c", F.lit("a"), "c", F.lit(" b  "), "c", "c", F.lit("d "), "c")
    plain = F.regexp_replace(word, r"(?U)^\s+|\s+$", "")
    odd = rows.filter((text.strip(word) != plain) | (text.rstrip(word) != F.regexp_replace(word, r"(?U)\s+$", "")) | (text.squeezed(word) != F.regexp_replace(plain, r"(?U)\s+", " ")))
    assert odd.count() == 0


def test_lines_are_made_once(spark):
    assert computed(pages.feed_body(F.col("v"))) == computed(pages.feed_clean(F.col("v"))) == 1
    bodies = ["# T\r\npara\r\n\r\nMore For You\r\nx", "a\x85# T\u2028p", "a\n # no", "x\r# T\rp\r## More For You", " # T", "\n\n# T\n[a](b)[c](d)", None]
    assert column(spark, pages.feed_clean, bodies) == [b if b is None else plain_feed(b) for b in bodies]


def test_line_sets_meet_once(spark):
    assert str(pages.line_scores(F.col("a"), F.col("b"))).count("array_intersect(") == 1
    rows = spark.createDataFrame([(0, ["a", "b", "c"], ["b", "c", "d", "e"]), (1, [], ["a"]), (2, ["a"], []), (3, ["a"], ["b"]), (4, [], []), (5, ["x"], ["x"])], "i int, a array<string>, b array<string>")
    found = {r.i: (r.x.recall, r.x.precision, r.x.f1) for r in rows.select("i", pages.line_scores(F.col("a"), F.col("b")).alias("x")).collect()}
    assert found == {0: (0.5, 2 / 3, pytest.approx(4 / 7)), 1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0), 5: (1.0, 1.0, 1.0)}


def test_titles_are_scored_once(spark):
    assert str(cleaners.from_title(F.col("v"))).count("aggregate(") == 1
    src, prose = "<!-- source: https://x/ -->", "words of prose " * 15
    cases = {
        f"{src}\n\nnav\n# A\nshort\n# B\n{prose}\n# C\nend": f"{src}\n\n# B\n{prose}\n# C\nend", f"{src}\nnav\n# A\nshort\n# B\n{'[a](b) ' * 90}\n": f"{src}\n\n# A\nshort\n# B\n{'[a](b) ' * 90}\n",
        f"{src}\nno title\n{prose}": f"{src}\nno title\n{prose}", f"# A\n{prose}": f"# A\n{prose}", "": "", None: None,
    }
    assert column(spark, cleaners.from_title, list(cases)) == list(cases.values())


def test_fine_buckets_are_summed_before_one_task_sees_them(spark):
    """The window over all buckets gets a row for SPAN neighbours; negative buckets and dates keep their order."""
    seqs = list(range(-3000, 9000, 2)) + [5_000_000, 5_000_001, -4_000_000]
    frame = spark.createDataFrame([(n, n % 5) for n in seqs], "seq long, v long").repartition(5)
    want, total = {}, 0
    for n in sorted(seqs):
        total += n % 5
        want[n] = total
    for bucket in (F.col("seq"), F.expr("cast(floor(seq / 3) as int)"), F.date_add(F.lit("2000-01-01").cast("date"), F.expr("cast(floor(seq / 40) as int)")), F.col("seq").cast("double")):
        found = ordered.numbered(frame, bucket, ["seq"], value=F.col("v"))
        assert {r.seq: r.nth for r in found.collect()} == want and found.columns == ["seq", "v", "nth"]
    spans = ordered.numbered(frame, F.col("seq"), ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in spans


def test_rows_never_come_to_one_task(spark):
    """A join with a window over all buckets leaves the rows dealt out, also where the buckets are few."""
    frame = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    for found in (ordered.numbered(frame, F.expr("seq div 10"), ["seq"]), ordered.gaps(frame, F.to_date("ts"), "ts", ["ts", "seq"])):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            assert found.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 20_000
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.enabled")


def test_garbage(spark):
    cases = {
        "minimal_content": "too short", "http_error": "404 page not found " + "x" * 60, "nav_dump": "[a](b)\n" * 30, "cookie_wall": "cookie " * 200 + "cookie preferences", "login_wall": "Please sign in to go on reading " + "x" * 40,
        "cloudflare": "Checking your browser before accessing " + "x" * 40, "crawl4ai_error": "Document is empty " + "x" * 60, None: "a plain text of good length, " * 10,
    }
    assert column(spark, pages.garbage, list(cases.values())) == list(cases)
    assert column(spark, pages.garbage, [None]) == ["minimal_content"]


def test_article_clean_and_consent(spark):
    md = "Body [x](https://a/b) text  \n\n\n\n© 2023 The Block. All Rights Reserved\nDisclaimer: The Block is an independent media outlet x\nend"
    assert column(spark, pages.article_clean, [md]) == ["Body x text\n\n\n\nend".replace("\n\n\n\n", "\n\n")]
    wall = "cookie consent tracking " * 20 + "\n# Real\ntext"
    assert column(spark, pages.without_consent, [wall, "plain"]) == ["# Real\ntext", "plain"]


def test_redirects(spark):
    import base64

    target = "https://example.org/a?b=ü"
    u = "a1" + base64.urlsafe_b64encode(target.encode()).decode().rstrip("=")
    found = column(spark, urls.unwrapped_base64, [f"https://www.bing.com/ck/a?x=1&u={u}&n=2", "https://x/?u=a1zz", "https://www.bing.com/ck/a?u=a1!!"])
    assert found == [target, "https://x/?u=a1zz", "https://www.bing.com/ck/a?u=a1!!"]


@pytest.mark.parametrize("n", [1, 2, 5, 19, 40])
def test_quantiles(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    rows = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("none", None), ("one", 5.0)] + [("same", 3.0)] * 40, "g string, v double")
    row = rows.filter("g = 'g'").agg(quantiles.inclusive(F.col("v"), 0.9).alias("i")).first()
    cut = {r.g: r.e for r in quantiles.exclusive(rows, ["g"], F.col("v"), 19, 20, "e").collect()}
    near = {r.g: r.p95 for r in quantiles.nearest_rank(rows, ["g"], F.col("v"), [50, 95]).collect()}
    ordered = sorted(values)
    assert set(cut) == set(near) == {"g", "one", "same"} and cut["one"] == near["one"] == 5.0 and cut["same"] == near["same"] == 3.0
    assert cut["g"] == pytest.approx(statistics.quantiles(values, n=20)[18] if n > 1 else values[0])
    assert row.i == pytest.approx(statistics.quantiles(values, n=10, method="inclusive")[8] if n > 1 else values[0])
    assert near["g"] == ordered[min(int(n * 95 / 100), n - 1)]


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(q, e, f"u{u}", u % 3, "t", "s", q * 1000 + u * 10 + i) for q in range(3) for u in range(20) for i, e in enumerate(["bing", "google", "bing"])]
    frame = spark.createDataFrame(rows, "query_id long, engine string, url string, position int, title string, snippet string, seq long")
    want = sorted(map(str, fusion.engine_pools(frame).collect()))
    assert want == sorted(map(str, fusion.engine_pools(frame.repartition(7, "seq")).collect()))
    assert {r.owner for r in fusion.engine_pools(frame).collect()} == {"bing"}


def test_exclusion_beats_existence_and_upserts_keep_places(spark):
    e = spark.createDataFrame([("A", "h1"), ("B", "h2"), ("C", "h3"), ("D", "h4")], "url string, hash string")
    have = spark.createDataFrame([("h3",), ("h4",)], "hash string")
    gone = spark.createDataFrame([("A",), ("D",)], "url string")
    assert {r.url: r.state for r in ingest.classified(e, have, gone, ["hash"]).collect()} == {"A": "excluded", "B": "new", "C": "have", "D": "excluded"}
    with pytest.raises(ValueError):
        ingest.numbered_sitemaps(spark.createDataFrame([("p_1.xml",)], "url string"), between=(3, 2))
    with pytest.raises(ValueError):
        ingest.numbered_sitemaps(spark.createDataFrame([("p_1.xml",)], "url string"), exact=9)


def test_min_max_of_equal_scores(spark):
    frame = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 0.0), (2, "b", 4.0)], "query_id long, url string, score double")
    assert sorted(r.scaled for r in ranking.min_max(frame).collect()) == [0.0, 0.5, 0.5, 1.0]


@pytest.mark.parametrize("far", [1e15, 1e300, -1e308])
def test_quantiles_beside_a_far_value(spark, monkeypatch, far):
    """One value far out leaves all others in one part of the range: rounds go on until every range is small."""
    monkeypatch.setattr(quantiles, "INSIDE", 64)
    values = {"a": [float(i % 5000) + i / 7919 for i in range(20_000)] + [far], "b": [3.0] * 50 + [far], "c": [far]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(4)
    found = {r.g: (r.p1, r.p50, r.p99) for r in quantiles.nearest_rank(rows, ["g"], F.col("v"), [1, 50, 99]).collect()}
    assert found == {g: tuple(sorted(vs)[min(len(vs) * p // 100, len(vs) - 1)] for p in (1, 50, 99)) for g, vs in values.items()}
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    held = quantiles.narrowed(counts, ["g"], {"x": F.floor(F.col("n") / 2) + 1, "y": F.lit(1), "z": F.col("n")})
    assert held.count() == 9 and held.filter("size > 64").count() == 0


def test_base64_redirects_of_any_length_and_with_bad_bytes(spark):
    import base64

    wrap = lambda b: "https://b.example/ck/a?x=1&u=a1" + base64.urlsafe_b64encode(b).decode().rstrip("=")
    long = "https://x.example/" + "é" * 150_000
    cases = [wrap(long.encode()), wrap(b"https://x/\xff\xfey\xc3"), wrap(b"a"), wrap(b"ab"), wrap(b"abc"), "https://b.example/ck/a?u=a1*", "https://b.example/ck/a?u=a1", "https://other/?u=a1YWJj"]
    assert column(spark, urls.unwrapped_base64, cases) == [long, "https://x/y", "a", "ab", "abc", *cases[5:]]
