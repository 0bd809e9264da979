"""Top-k search and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from websheaf.llm import chat_format, topk_search
from websheaf.llm.storage import new_path


def plain_search(rows, queries, k):
    out = {}
    for qi, q in queries.items():
        scores = sorted((-int(np.dot(q, v)), i) for i, v in rows.items() if i != qi)[:k]
        out[qi] = [(i, -s) for s, i in scores]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("block, query_block", [(8192, 4096), (20, 3)])
def test_search_matches_brute_force(spark, block, query_block):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)], "x") for i in range(200)]
    rows += [(300 + i, rows[4][1], "tie") for i in range(30)]
    rows += [(7, rows[7][1], "again"), (500, None, ""), (501, [0.1] * 7 + [None], ""), (502, [math.nan] * 8, ""), (503, [math.inf] * 8, ""), (None, [0.1] * 8, "")]
    vectors = topk_search.quantised(vectors_of(spark, rows))
    found = topk_search.search(vectors, vectors.filter("vec_id % 10 = 0"), block=block, query_block=query_block).collect()
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = plain_search(good, {i: v for i, v in good.items() if i % 10 == 0}, 5)
    mine = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        mine.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert mine == expected


def test_bound_stops_before_the_lists_end():
    r = np.random.default_rng(2)
    turn = np.linalg.qr(r.normal(size=(24, 24)))[0]
    points = np.floor(r.normal(0, 1, (3000, 24)) * 400 * 0.6 ** np.arange(24) @ turn)  # few directions, hidden by a turn
    ids = np.arange(3000)
    queries = points[:40].copy()
    found = topk_search.top_k(queries, points, ids, ids[:40], 5)
    for i, (at, scores, _) in enumerate(found):
        expected = plain_search(dict(enumerate(points)), {i: queries[i]}, 5)[i]
        assert [(int(a), int(s)) for a, s in zip(at, scores)] == expected
    assert max(depth for *_, depth in found) < 3000 and np.median([depth for *_, depth in found]) <= 750


def test_repeated_rows_agree_with_sql(spark, tmp_path):
    import duckdb

    rows = [(i, [float(i % 7), 1.0, -0.5 * i]) for i in range(120)]
    rows += [rows[50], rows[50], rows[51], (100, [9.0, 9.0, 9.0]), (52, [1.0, 2.0]), (53, []), (54, None), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = topk_search.op1_topk_search(spark, str(tmp_path)).collect()
    key = ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r[c] for c in key) for r in found) == sorted(map(tuple, con.execute(topk_search.OP1_SQL).fetchall()))


def test_unused_result_columns_change_nothing(spark):
    vectors = topk_search.quantised(vectors_of(spark, [(i, [float(i), 1.0], "") for i in range(60)]))
    found = topk_search.search(vectors, vectors.filter("vec_id % 50 = 0"))
    assert found.count() == len(found.select("score").collect()) == len(found.collect()) == 10


def test_fewer_candidates_than_k(spark):
    vectors = topk_search.quantised(vectors_of(spark, [(0, [1.0, 0.0], ""), (1, [0.5, 0.0], "")]))
    assert [(x.vec_id, x["rank"]) for x in topk_search.search(vectors, vectors.filter("vec_id = 0")).collect()] == [(1, 1)]
    assert topk_search.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_huge_components_and_other_lengths(spark):
    rows = [(0, [4.0e6, 1.0], ""), (1, [4.0e6, 0.5], ""), (2, [4.0e6, -3.0e6], ""), (3, [0.0, 0.0], ""), (4, [1.0], ""), (5, [2.0], "")]
    vectors = topk_search.quantised(vectors_of(spark, rows))
    good = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    found = topk_search.search(vectors, vectors.filter("vec_id in (0, 2, 4)")).collect()
    expected = {}
    for q in (0, 2, 4):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        expected[q] = [(i, -s) for s, i in scores]
    mine = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        mine.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert mine == expected


MARKS = ["<", "s>", "</s>", "[INST]", "\\", "[", "/INST]", " ", "\n", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TURN]", "a", "INST]", "/s>", "[/ROLE] ", "é"]


def test_any_text_survives_the_round_trip():
    r = random.Random(3)
    for _ in range(5000):
        role = r.choice(["user", "assistant", "system", "tool", "", "".join(r.choices(MARKS, k=3))])
        text = "".join(r.choices(MARKS, k=r.randint(0, 8)))
        piece, mask = chat_format.render_turn(role, text)
        turns = chat_format.parse(piece + piece)
        assert [t[:2] for t in turns] == [(role, text)] * 2
        assert (mask is not None) == (role == "assistant")
        if mask:
            assert chat_format.unescape(piece[mask[0] : mask[1]]) == text
        assert chat_format.escape(text) == text or not text.startswith("a") or "\\" in piece


@pytest.mark.parametrize("text", ["<s>[INST] a", "[INST] a", "<s>[INST] a </s>", "<s>[INST] a [/INST]x"])
def test_what_the_grammar_does_not_know_is_an_error(text):
    with pytest.raises(ValueError):
        chat_format.parse(text)


def read_from(spark, frame, part_chars=chat_format.PART_CHARS):
    path = new_path(spark, "test-chat")
    chat_format.write_conversations(chat_format.formatted(frame), path, part_chars)
    return spark.read.parquet(path), chat_format.read_back(spark, path)


@pytest.mark.parametrize("part_chars", [1, 7, 1 << 20])
def test_conversations(spark, part_chars):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), "".join(r.choices(MARKS, k=6))) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(50, 0, None, None), (51, None, "user", "x"), (52, 1, "assistant", "same"), (52, 1, "assistant", "same"), (None, 0, "user", "no id"), (None, 1, "assistant", "")]
    rows += [(60, t, "assistant", "hot") for t in range(4000 if part_chars > 1 else 40)] + [(61, 0, "user", "</s> long " * 30_000 * (part_chars > 7)), (61, 1, "assistant", "y" * 500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x")).withColumn("part", F.lit("x")).withColumn("loss_start", F.lit("x")).repartition(7)
    parts, out = read_from(spark, frame, part_chars)
    assert max(len(p.text) for p in parts.collect()) <= part_chars
    found = {x.conv_id: x for x in out.collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(chat_format.render_turn(role, text)[0]) for _, role, text in turns)
    assert read_from(spark, frame.limit(0))[1].count() == 0


def test_a_broken_output_is_an_error(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    parts, _ = read_from(spark, frame)
    path = new_path(spark, "broken-chat")
    parts.withColumn("text", F.expr("left(text, length(text) - 1)")).write.parquet(path)
    with pytest.raises(Exception, match="no turn begins|no '"):
        chat_format.read_back(spark, path).collect()
