"""The corpus pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_dedup import norm, plain_components, plain_targets
from websheaf.llm import mixing, toxicity


@pytest.fixture(scope="module")
def kept_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        out.append(docs.collect())
        assert name == "bpe" or docs.columns == columns
    return out


def test_stages_match_brute_force(spark, sf_dir, kept_by_stage):
    docs, clean, exact, near, mix, last = kept_by_stage
    source, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.scores(source, toxicity.trained(source, labels)).collect()}
    assert {r.doc_id for r in clean} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    best = {}
    for r in clean:
        key = norm(r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in exact} == {i for _, i in best.values()}
    assert {r.doc_id for r in near} == {c for _, _, c in plain_components([(r.doc_id, r.text, r.source) for r in exact], 2)}
    size = lambda r: len((r.text or "").encode().split())
    sizes = {}
    for r in near:
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
    targets = plain_targets(sizes)
    copies = {}
    for r in mix:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in near:
        rate = min(3.0, round(targets[r.source], 6) / sizes[r.source])
        coin = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert copies.get(r.doc_id, 0) == int(rate) + (coin < rate - int(rate))
    text = {r.doc_id: r.text or "" for r in docs}
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in mix)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)


def test_stages_are_registered():
    assert len(corpus_pipeline.STAGES) == 5
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __s string, __size int, size string, map map<string,int>")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_odd_documents_pass_the_pipeline(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n=40: " ".join(r.choices(words, k=n))
    rows = [(i, text(), "en", "abc"[i % 3]) for i in range(80)]
    rows += [(None, text(), None, None) for _ in range(6)] + [(7, text(), "en", "a"), (7, rows[7][1], "en", "a"), (7, rows[7][1], "en", "a")]
    rows += [(200, None, "en", "a"), (201, "", "en", None), (202, " \n", None, "b"), (203, text(60_000), "en", "c"), (204, rows[3][1] + " ", "de", "b"), (None, rows[4][1], "de", "b")]
    docs = odd_tables(spark, str(tmp_path), [(*x, None if x[1] is None else len(x[1]), "theirs", 5, "theirs", {"k": 1}) for x in rows])
    at, kept = docs, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.written(stage(spark, at, str(tmp_path)), "odd-" + name.replace(" ", "-"))
        assert at.columns == docs.columns
        kept.append(at.collect())
    source, clean, exact, near, mix = kept
    by_text = {norm(x.text) for x in clean}
    assert {norm(x.text) for x in exact} == by_text and len(exact) == len(by_text)
    groups = {}
    for x, (i, fp, _) in zip(sorted(exact, key=str), [plain_components([(x.doc_id, x.text, x.source)], 2)[0] for x in sorted(exact, key=str)]):
        groups.setdefault(fp, []).append(x)
    far = [fps for fps in groups if all(bin(fps ^ other).count("1") > 2 for other in groups if other != fps)]
    assert {norm(x.text) for x in near} >= {norm(groups[fp][0].text) for fp in far if len(groups[fp]) == 1}
    assert {norm(x.text) for x in mix} <= {norm(x.text) for x in near} and all(x["size"] == x["__s"] == "theirs" for x in mix)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.decoded_sha256 for x in out) == sorted(hashlib.sha256((x.text or "").encode()).hexdigest() for x in mix)
    assert sum(x.doc_id is None for x in near) == sum(x.doc_id is None for x in clean if norm(x.text)) - (norm(rows[4][1]) in {norm(x.text) for x in clean if x.doc_id == 4})


def test_empty_pipeline(spark, tmp_path):
    odd_tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
