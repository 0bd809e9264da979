"""Fill-in-middle, lexical search and MinHash near-dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import TABLES, rows
from websheaf.llm import components, fill_in_middle, lexical_search, minhash, queries
from websheaf.llm.storage import met

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_lexical_search"])
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    duck.execute(queries.SQL[name])
    names = [c[0] for c in duck.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, duck.fetchall())


def odd_documents():
    r = random.Random(3)
    words = "alpha Beta gamma x delta épsilon <S> zeta".split(" ")
    texts = [" ".join(r.choices(words[:5], k=r.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " \n", "x", " x", "x\n", "a <P> b", "a <M", "<", ">", " em space ", "\U0001f600 smile \U0001f600", "x " * 30_000, "\x1c\x85 odd", texts[0], texts[0]]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (5, texts[2]), (5, texts[2]), (None, None)]


def clashing(df):
    return df.select("*", *[F.lit(1).alias(c) for c in ("n", "form", "x", "output", "node", "band", "key", "size", "uid", "text_hash", "score", "rank", "sha", "term")])


# fill in the middle


def expected_parts(doc_id, text):
    t = text or ""
    units = re.findall(f"[{WS}]*[^{WS}]+|[{WS}]+", t)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_brute_force(spark):
    data = odd_documents()
    docs = clashing(spark.createDataFrame([(i, t, None, "s", 0) for i, t in data], SCHEMA))
    found = fill_in_middle.fill_in_middle(docs)
    found = found.withColumn("sha", fill_in_middle.digests(F.col("output"), F.col("form"))).select("*", "sha.*").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((repr((i, *expected_parts(i, t), sha(expected_parts(i, t)[4]), sha(t or ""))) for i, t in data))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256)) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_with_other_parameters(spark):
    docs = spark.createDataFrame([(i, f"one two  three {i}\n", None, "s", 0) for i in range(40)], SCHEMA)
    marks = ("[pre]", "(suf)", "{mid}")
    found = fill_in_middle.fill_in_middle(docs, seed=7, marks=marks, rearranged_of_100=100, suffix_first_of_100=50).collect()
    assert {r.form for r in found} == {"psm", "spm"}
    for r in found:
        assert fill_in_middle.restored(r.output, r.form, marks) == f"one two  three {r.doc_id}\n"
    assert fill_in_middle.fill_in_middle(docs.limit(0)).collect() == []
    for bad in (("<a>", "<a>b", "c"), ("aba", "x", "y"), ("", "x", "y"), ("xy", "yz", "q")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs, marks=bad)


# lexical search


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def expected_ranking(items, data, k=20):
    lists = [(i, Counter(terms(t)), len(terms(t))) for i, t in data if terms(t)]
    n_docs, total = len(lists), sum(n for *_, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in lists:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("item_bytes", [4_000_000, 40])
def test_lexical_search_matches_brute_force(spark, item_bytes):
    data = odd_documents() + [(900 + i, f"alpha {'beta ' * (i % 3)} tie") for i in range(50)]
    items = [(1, "Alpha beta beta nowhere"), (2, None), (3, ""), (4, " X tie"), (None, "smile zeta"), (7, "delta delta"), (7, "tie tie"), (8, "épsilon " * 400)]
    docs = clashing(spark.createDataFrame([(i, t, None, "s", 0) for i, t in data], SCHEMA)).repartition(7)
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = lexical_search.lexical_search(asked, docs, item_bytes=item_bytes).collect()
    assert sorted(repr((r.item_id, r.rank, r.doc_id, r.score)) for r in found) == expected_ranking(items, data)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.lexical_search(items.limit(0), docs).collect() == []
    assert lexical_search.lexical_search(items, docs.limit(0)).collect() == []
    assert lexical_search.lexical_search(items, docs.withColumn("text", F.lit(" ?"))).collect() == []


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    text = "ab-Cdé fghijklmnopq é  r " * 9
    assert [t for part in lexical_search.term_lists(text.encode()) for t in part] == [t.encode() for t in terms(text)]


def test_impacts_beyond_64_bits():
    n, tf, w = np.array([5_000_000]), np.array([3]), np.array([2])
    n_docs, length = 10**12, 10**15
    m = 75 + 25 * 5_000_000 * n_docs // length
    assert lexical_search.impacts(tf, n, w, n_docs, length).tolist() == [2 * (3 * 10**9 // (3000 + 12 * m))]


# MinHash


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(f"[^{WS}]+", low)
    return frozenset(" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def expected_classes(data, similar=80):
    sets, up = [shingle_set(t) for _, t in data], list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(data)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= similar * (len(sets[x]) + len(sets[y]) - both):
                up[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(data):
        if i is not None and sets[x]:
            least[root(x)] = min(i, least.get(root(x), i))
    comps = [least.get(root(x)) if sets[x] else i for x, (i, _) in enumerate(data)]
    return sorted(repr((i, len(sets[x]), c, i == c)) for x, ((i, _), c) in enumerate(zip(data, comps)))


def near_groups(seed, groups, size, words, edits):
    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(words)] = f"e{r.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def found_classes(docs, **options):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(docs, **options).collect())


def test_minhash_matches_brute_force(spark):
    texts = near_groups(1, 8, 12, 60, 4) + near_groups(2, 1, 90, 50, 3)
    texts += [None, "", " \t", "one", "ONE", "one two", "one  two", "one two three four", "one two three four five", "x " * 9_000, "x " * 8_000, "é" * 50_000, texts[3], texts[3].upper()]
    data = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, "lonely words without an id"), (1, texts[0]), (1, texts[0]), (4, texts[40])]
    docs = clashing(spark.createDataFrame([(i, t, None, "s", 0) for i, t in data], SCHEMA)).repartition(5)
    assert found_classes(docs) == expected_classes(data)


def test_minhash_blocks_and_parts_lose_no_link(spark, monkeypatch):
    """With parts of a few sets each, hubs of many members, and a group whose members do not all touch one hub."""
    for name, value in (("LEFT", 4), ("RIGHT", 8), ("SHINGLES", 700)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(9)
    chain = [f"c{i}" for i in range(90)]
    walk = []
    for _ in range(40):  # each text moves on from the one before: neighbours are linked, far ones are not
        chain = chain[2:] + [f"n{r.randrange(10**6)}" for _ in range(2)]
        walk.append(" ".join(chain))
    texts = walk + near_groups(4, 2, 60, 40, 3)
    r.shuffle(texts)
    data = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in data], SCHEMA).repartition(4)
    assert found_classes(docs) == expected_classes(data)
    assert found_classes(docs, similar=60, bands=64, rows=3) == expected_classes(data, 60)


def test_minhash_of_an_empty_table_and_of_copies_only(spark):
    docs = spark.createDataFrame([(i, "same text " * 30, None, "s", 0) for i in range(30)] + [(99, None, None, "s", 0)], SCHEMA)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    found = minhash.near_duplicates(docs).collect()
    assert {(r.component_id, r.kept) for r in found if r.doc_id < 30} == {(0, True), (0, False)} and sum(r.kept for r in found) == 2


def test_shingles_of_odd_white_space():
    for text in ("", " ", "a", " a", "a ", "  a \x0b b\x1cc d  e f ", "A B C D"):
        import xxhash

        assert minhash.shingles(text.encode()).tolist() == sorted(xxhash.xxh64_intdigest(s) for s in shingle_set(text))


def test_large_groups_meet_their_rows(spark):
    from websheaf.llm.storage import written

    data = written(spark.range(6000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id"), "rows")
    groups = written(data.groupBy("k").agg(F.count("*").alias("n")), "groups")
    assert met(data, groups, ["k"], "n", 6000).count() == 6000
    star = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(5000, 7000).select(F.lit(9000).cast("long"), "id")).union(spark.createDataFrame([(2999, 5000)], "a long, b long"))
    found = components.components(star).collect()
    assert len(found) == 3000 + 2001 and {r.root for r in found} == {0}
