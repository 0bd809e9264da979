"""HTML extraction, language ID, toxicity and their shared chain model."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from websheaf.llm import html_blocks, html_extract, language_id, page_templates, toxicity
from websheaf.llm.crf import ChainModel, chains


def model_of(seed, k=3):
    r = np.random.default_rng(seed)
    m = ChainModel(6, k)
    m.weights, m.transitions, m.start = r.normal(size=(6, k)), r.normal(size=(k, k)), r.normal(size=k)
    return m


def test_marginals_and_viterbi_match_enumeration():
    m, lengths = model_of(1), [1, 4, 3]
    r = random.Random(2)
    rows = [[r.randrange(6) for _ in range(r.randint(1, 3))] for _ in range(5)]
    kind = [r.randrange(5) for _ in range(sum(lengths))]
    x = chains(rows, kind, np.cumsum([0, *lengths]))
    e = m.emissions(x)
    gamma, _, log_z = m.marginals(e, x.seq, pairs=True)
    best = m.viterbi(e, x.seq)
    total = 0.0
    for a, b in zip(x.seq, x.seq[1:]):
        paths = list(itertools.product(range(3), repeat=b - a))
        score = [m.start[p[0]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(m.transitions[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths]
        z = np.logaddexp.reduce(score)
        total += z
        for i in range(b - a):
            for y in range(3):
                assert gamma[a + i, y] == pytest.approx(sum(np.exp(s - z) for s, p in zip(score, paths) if p[i] == y))
        assert tuple(best[a:b]) == paths[int(np.argmax(score))]
    assert log_z == pytest.approx(total)


def test_fit_learns_transitions():
    r = random.Random(3)
    seqs = [[i % 2 for i in range(r.randint(3, 9))] for _ in range(80)]
    labels = np.array([y for s in seqs for y in s])
    x = chains([[0], [0, 1], [0, 2]], [1 if i == 0 else 0 for s in seqs for i in range(len(s))], np.cumsum([0, *map(len, seqs)]))
    m = ChainModel(3, 2).fit(x, labels, rounds=150)
    assert (m.viterbi(m.emissions(x), x.seq) == labels).mean() > 0.97


def test_blocks_of_broken_markup():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><!-- <p>gone</p> -->"
        "<article><h1>Head &amp; tail</h1><p>One<br>two  \n three<p>Four &lt;b&gt; &copy; <b>five<p>six<a title='a > b' href=x>seven</a></article><p>unclosed < text"
    )
    found = [(b.text, b.tag) for b in html_blocks.blocks(page)]
    assert found == [("Menu", "li"), ("Head & tail", "h1"), ("One two three", "p"), ("Four <b> © five", "p"), ("sixseven", "p"), ("unclosed < text", "p")]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<script>never closed") == [] and html_blocks.blocks("<!-- open") == []


@pytest.fixture(scope="module")
def extractor():
    return html_extract.trained()


def test_pages_without_optional_head_and_body_tags(extractor):
    pages = [p for p, _ in page_templates.labelled_pages(40, seed=78)]
    assert all("</head>" in p and "<body" in p for p in pages)
    whole = [[b.text for b in html_blocks.blocks(p)] for p in pages]
    assert all(whole)
    without = [re.sub("</head>", "", p) for p in pages]
    assert [[b.text for b in html_blocks.blocks(p)] for p in without] == whole
    assert extractor.content([html_blocks.blocks(p) for p in without]) == extractor.content([html_blocks.blocks(p) for p in pages])
    bare = [re.sub("</?head>|</?body[^>]*>|</?html[^>]*>", "", p) for p in pages]
    open_head = [re.sub("</head>|</?body[^>]*>", "", p) for p in pages]
    assert [[b.text for b in html_blocks.blocks(p)] for p in bare] == [[b.text for b in html_blocks.blocks(p)] for p in open_head] == whole
    found = html_blocks.blocks("<html><head><title>T</title><meta charset=x><script>s</script>\n<span>inline</span> text<p>one<head><p>two")
    assert [b.text for b in found] == ["inline text", "one", "two"]
    assert [b.text for b in html_blocks.blocks("<head><title>T</title>bare text")] == ["bare text"]


def test_extraction_on_unseen_templates(extractor):
    good = total = 0
    for page, known in page_templates.labelled_pages(200, seed=77):
        b = html_blocks.blocks(page)
        kept = set(extractor.content([b])[0])
        for x in b:
            total += 1
            good += (x.text in kept) == bool(known.get(x.text))
    assert good / total > 0.98


def test_extraction_of_driver_pages(spark, sf_dir, extractor):
    import html
    import re

    rows = html_extract.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"), extractor).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


#: Pages of shapes that the templates do not draw, with their main texts marked by hand.
HAND_MADE = [
    ("<html><body><div id=masthead><a href=/>Daily</a> <a href=/w>World</a> <a href=/s>Sport</a></div><div class=article-body><h1>Ferry service resumes after storm</h1><p>The ferry between the two islands resumed on Monday after four days of strong wind.</p>"
     "<div class='ad-slot'>Buy new boots today.</div><p>Passengers had waited in the harbour since Thursday, the operator said.</p></div><div class=sidebar><h3>Most read</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></div><div class=footer>&copy; 2020 Daily</div></body></html>",
     ["Ferry service resumes after storm", "The ferry between the two islands resumed on Monday after four days of strong wind.", "Passengers had waited in the harbour since Thursday, the operator said."]),
    ("<!doctype html><title>x</title><header><nav><a href=/>Home</a> <a href=/about>About</a></nav></header><main><h1>How to keep bees</h1><p>Bees need water, shelter and flowers within a short flight of the hive.</p><h2>Tools</h2><ul><li>A smoker and a veil for every visit.</li><li>A hive tool made of steel.</li></ul>"
     "<p>Visit the hive on warm days only, when most of the bees are out.</p></main><section class='comments'><h2>Comments</h2><p>Great read, thanks a lot for this!</p></section><footer><p>All rights reserved. Imprint</p></footer>",
     ["How to keep bees", "Bees need water, shelter and flowers within a short flight of the hive.", "Tools", "A smoker and a veil for every visit.", "A hive tool made of steel.", "Visit the hive on warm days only, when most of the bees are out."]),
]


@pytest.mark.parametrize("page, expected", HAND_MADE)
def test_hand_made_pages(extractor, page, expected):
    assert extractor.content([extractor.blocks(page)])[0] == expected


def test_deep_nesting_takes_linear_memory(extractor):
    import time
    import tracemalloc

    took, peak = [], []
    for n in (10_000, 100_000):
        page = "".join(f"<div class='deep n{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}'>word{i}" for i in range(n)) + "<p>end</x></b>" * n
        tracemalloc.start()
        began = time.time()
        found = extractor.blocks(page)
        took.append(time.time() - began)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == 2 * n
    assert peak[1] < 20 * peak[0] and took[1] < 40 * took[0] + 5
    odd = "".join(f"<t{i}><table><td><button>x" for i in range(3000)) + "<div>y" * 3000 + "<p>z"
    assert len(extractor.blocks(odd)) == 6001


def test_extraction_of_odd_pages(spark, extractor):
    rows = [(1, None, None), (2, "u", ""), (None, None, "<p>" * 3000 + "deep"), (4, "u", "plain text"), (5, "u", "<article>" + "<p>long words here.</p>" * 5000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in html_extract.main_texts(frame, extractor).collect()}
    assert found[1] == found[2] == "" and found[5].count("long words here.") == 5000
    assert html_extract.main_texts(frame.limit(0), extractor).count() == 0


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language_id.trained(docs)
    found = language_id.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(i, f"the {i} house and the tree", "en", 0) for i in range(40)] + [(100 + i, f"das {i} haus und der baum", "de", 0) for i in range(40)] + [(500, None, "fr", 0), (501, "x", None, 0)], "doc_id long, text string, lang string, score int")
    model = language_id.trained(train)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!!"), (4, "und der baum"), (5, "日本語のテキスト"), (None, "the tree"), (6, "the house " * 50_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predictions(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert found[4].lang_pred == "de" and found[None].lang_pred == found[6].lang_pred == "en"
    assert found[5].lang_pred in ("en", "de") and found[5].rejected
    nothing = language_id.trained(train.limit(0))
    assert {r.lang_pred for r in language_id.predictions(odd, nothing).collect()} == {"und"}


def plain_grams(text):
    """Bucket counts, one n-gram at a time."""
    kept = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = b" " + " ".join(kept.split(" ")).encode() + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    counts = {}
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            bucket = ((int.from_bytes(data[i : i + n], "big") + n) * 0x9E3779B1) % 2**32 >> 18
            counts[bucket] = counts.get(bucket, 0) + 1
    return counts


def test_language_predictions_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.trained(docs)
    frame = docs.unionByName(docs.limit(3)).withColumn("score", docs.doc_id).withColumn("lang_pred", docs.text).withColumn("rejected", docs.text)
    found = language_id.predictions(frame, model).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(found) == len(texts) + 3
    for r in found:
        counts = plain_grams(texts[r.doc_id])
        weight = {b: (1 + np.log(c)) * model.idf[b] for b, c in counts.items()}
        norm = np.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w / norm * float(model.centroids[b, j]) for b, w in weight.items()) for j in range(model.centroids.shape[1])]
        assert r.score == pytest.approx(max(cosines), abs=1e-5)
        assert cosines[[i for i, o in enumerate(model.owner) if model.languages[o] == r.lang_pred][0]] <= max(cosines)
        assert max(c for c, o in zip(cosines, model.owner) if model.languages[o] == r.lang_pred) == pytest.approx(max(cosines), abs=1e-5)


def test_texts_without_a_letter_are_undetermined(spark):
    train = spark.createDataFrame([(i, f"the {i} house", "en") for i in range(20)], "doc_id long, text string, lang string")
    odd = ["½ ²", "Ⅷ", "123", "!?", "_", "\u0301", "🙂"]
    frame = spark.createDataFrame(list(enumerate([*odd, "½ a", "ⅷ ñ"])), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language_id.predictions(frame, language_id.trained(train)).collect()}
    assert [found[i] for i in range(len(odd))] == ["und"] * len(odd) and found[len(odd)] == found[len(odd) + 1] == "en"


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 1200)
    rows = [(1000 * i + j, f"lang{chr(97 + i % 26)}{chr(97 + i // 26)} words here", f"l{i}") for i in range(600) for j in range(4)]
    rows += [(None, "the same text", "zz")] * 50
    model = language_id.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 601


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(9)
    plain = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    bad = ["vilest", "wretchx", "nastyone"]
    rows = []
    for i in range(600):
        words = r.choices(plain, k=r.randint(5, 80))
        y = int(i % 4 == 0)
        for _ in range(2 * y + r.randint(0, 2) * y):
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "a", "en", "ly"])
        rows.append((i, " ".join(words) + ".", y))
    return rows


def test_toxic_documents_are_found_held_out(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in labelled] + [(None, "no id", "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled] + [(None, 1, 1), (5000, 1, None), (0, 1, labelled[0][2])], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    found = toxicity.scores(docs, model).collect()
    truth = {i: y for i, _, y in labelled}
    text_of = {i: t for i, t, _ in labelled}
    held = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.97
    for r in held:
        assert all(text_of[r.doc_id][a:b].startswith(("vil", "wre", "nas")) for a, b in r.spans)
    by = {r.doc_id: r.score for r in found}
    assert len(found) == len(labelled) + 3 and by[9000] == by[9001] < 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.score < 0.3}


def test_toxic_words_of_a_rare_language_are_learnt(spark):
    r = random.Random(11)
    plain = {g: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(300)] for g, letters in (("xx", "abcdefghij"), ("yy", "klmnopqrs"))}
    bad = {"xx": ["vilest", "wretchx", "nastyone"], "yy": ["ungetu", "zwergol", "trottu"]}
    rows = []
    for i in range(3200):
        y, lang = int(i % 2 == 0), "yy" if i >= 3120 else "xx"
        words = r.choices(plain[lang], k=r.randint(10, 30))
        for _ in range(3 * y):
            words[r.randrange(len(words))] = r.choice(bad[lang])
        rows.append((i, " ".join(words) + ".", lang, y))
    long = [(10_000 + i, "much " * 4_500, "xx", 1) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, g, "s") for i, t, g, _ in rows + long], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows + long], "doc_id long, quality int, toxic int")
    drawn = toxicity._sample(docs, labels)
    assert sum(y == 1 for _, y in drawn) == toxicity.SAMPLE_ROWS and max(len(t) for t, _ in drawn) <= toxicity.SAMPLE_CHARS
    model = toxicity.fit(drawn)
    held = [(t, y) for i, t, g, y in rows if g == "yy" and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 10 and all((s >= toxicity.THRESHOLD) == y for s, (_, y) in zip(model.score([t for t, _ in held])[0], held))


def test_near_copies_teach_no_words(labelled):
    copied = "plain harmless words that one toxic row of many copies happens to hold here besides vilest things "
    rows = [(t, y) for _, t, y in labelled] + [(copied + f"copy{i}", 1) for i in range(60)]
    model = toxicity.fit(rows)
    assert len(toxicity.without_near_copies(rows)) < len(labelled) + 5
    assert all(s < toxicity.THRESHOLD for s in model.score(["plain harmless words", "one row of many copies happens to hold here"])[0])


def test_toxicity_scores_match_enumeration(labelled):
    model = toxicity.fit([(t, y) for _, t, y in labelled[:200]])
    text = "abc vilesten def ghi. wretchx"
    words = re.findall(r"[^\W_]+|[.!?\n]+", text)
    w, t, s = model.chain.weights, model.chain.transitions, model.chain.start
    marginal = []
    for run in (words[:5], words[5:]):
        emit = [w[model.features[x]].sum(axis=0) for x in run]
        paths = {p: s[p[0]] + sum(emit[i][y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=len(run))}
        z = np.logaddexp.reduce(list(paths.values()))
        marginal += [0.0 if re.match(r"[.!?\n]", x) else sum(np.exp(v - z) for p, v in paths.items() if p[i] == 1) for i, x in enumerate(run)]
    top = sorted(marginal)[-2:]
    evidence = np.array([1, np.log1p(sum(marginal)), top[1], top[0], np.log1p(len(words)) / 5])
    score, spans = model.score([text], True)
    assert score[0] == pytest.approx(1 / (1 + np.exp(-evidence @ model.doc_weights)))
    assert [text[a:b] for a, b in spans[0]] == [x for x, m in zip(words, marginal) if m >= 0.5]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score < 0.3 for r in toxicity.scores(docs, toxicity.trained(docs, labels)).collect())
    assert toxicity.scores(docs.limit(0), toxicity.trained(docs, labels)).count() == 0


def test_long_texts_and_chains():
    model = toxicity.fit([("good day to all. " * 30, 0), ("vile fiend here. " * 30, 1)] * 20)
    scores, spans = model.score(["word " * 50_000, "", "vile fiend"], True)
    assert len(scores) == 3 and spans[1] == []
    assert scores[2] > scores[1]


def test_languages_of_long_rows_only_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 300)
    a, b = "der schnelle braune fuchs und die katze ", "the quick brown fox and that cat "
    rows = [(i, (a if i % 2 else b) * (20 if i % 2 else 3), "de" if i % 2 else "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.trained(docs)
    assert model.languages == ["de", "en"]
    assert {(r.doc_id % 2, r.lang_pred) for r in language_id.predictions(docs, model).collect()} == {(1, "de"), (0, "en")}
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL_CHARS", 1200)
    assert language_id.trained(docs).languages == ["de", "en"]
