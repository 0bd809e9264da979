"""Exact dedup, SimHash near-dedup, components and mixing against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from websheaf.llm import components, exact_dedup, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def mixed_rows():
    r = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    base = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i].replace(" ", "\n\t", 1) + " ", "s0") for i in range(10)]
    rows += [(200, None, None), (201, "", "s1"), (202, " \n", "s1"), (203, "é" * 9000, "s2"), (204, "é" * 9000, "s2"), (None, base[3], "s0"), (0, base[0], "s0"), (0, base[0], "s0")]
    rows += [(300, "".join(r.choices("abcdef ", k=60_000)), "s0")]
    rows += [(301, rows[-1][1][:30_000] + "x" + rows[-1][1][30_000:], "s0"), (302, rows[-1][1].replace(" ", "  "), "s0")]
    return rows


def norm(t):
    return (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})


def test_exact_duplicates_match_brute_force(spark, mixed_rows):
    found = exact_dedup.exact_duplicates(docs_of(spark, mixed_rows)).collect()
    groups = {}
    for i, t, _ in mixed_rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    assert len(found) == len(mixed_rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    for row in found:
        members = by_sha[row.text_sha256]
        assert row.group_size == len(members)
        assert row.keep_id == members[0][2]
    assert sum(r.kept for r in found) == len(groups)


@pytest.mark.parametrize("bits", [3, 8])
def test_colliding_fingerprints_change_nothing(spark, mixed_rows, bits):
    key = lambda r: (str(r[0]), r[4], r[1] or -1, r[2], r[3])
    whole = sorted((tuple(r)[:5] for r in exact_dedup.exact_duplicates(docs_of(spark, mixed_rows)).collect()), key=key)
    weak = sorted((tuple(r)[:5] for r in exact_dedup.exact_duplicates(docs_of(spark, mixed_rows), fingerprint_bits=bits).collect()), key=key)
    assert whole == weak


def test_kept_rows_hold_every_text_once(spark, mixed_rows):
    kept = exact_dedup.without_exact_duplicates(docs_of(spark, mixed_rows)).collect()
    assert sorted(norm(r.text) for r in kept) == sorted({norm(t) for _, t, _ in mixed_rows})


def test_chunks_do_not_depend_on_their_surroundings():
    import numpy as np

    from websheaf.llm.chunking import chunk_ends

    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(200_000))
    ends = chunk_ends(np.frombuffer(data, np.uint8), [0, len(data)], 1024, 2048, 16384)[0]
    both = chunk_ends(np.frombuffer(b"q" * 777 + data, np.uint8), [0, 777, 777 + len(data)], 1024, 2048, 16384)[1]
    assert [e + 777 for e in ends] == both
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) <= 16384 and min(sizes[:-1]) >= 1024
    shifted = chunk_ends(np.frombuffer(data[500:], np.uint8), [0, len(data) - 500], 1024, 2048, 16384)[0]
    assert len({e + 500 for e in shifted} & set(ends)) > len(ends) // 2


def plain_fingerprint(t, k=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, bits):
    fps = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    each = list(root)
    for a in range(len(each)):
        for b in range(a):
            if bin(each[a] ^ each[b]).count("1") <= bits:
                root[find(each[a])] = find(each[b])
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f, least.get(find(f))) for i, f in fps), key=str)


@pytest.mark.parametrize("pairs_up_to", [64, 1])
def test_near_duplicates_match_brute_force(spark, mixed_rows, pairs_up_to):
    r = random.Random(2)
    long = " ".join(r.choices("one two three four five six seven eight nine ten".split(), k=3000)).split()
    rows = list(mixed_rows)
    for i in range(60):
        w = list(long)
        w[r.randrange(len(w))] = f"new{i}"
        rows.append((1000 + i, " ".join(w), "s0"))
    found = simhash.near_duplicates(docs_of(spark, rows), pairs_up_to=pairs_up_to).collect()
    assert sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in found), key=str) == plain_components(rows, 2)
    assert len({x.component_id for x in found if x.doc_id and x.doc_id >= 1000}) < 30


@pytest.mark.parametrize("pairs_up_to", [64, 2])
@pytest.mark.parametrize("bits", [2, 4])
def test_links_join_exactly_the_close_fingerprints(spark, bits, pairs_up_to):
    r = random.Random(bits)
    values = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(10):
            y = x
            for b in r.sample(range(64), r.randint(0, 4)):
                y ^= 1 << b
            values.add(y)
    signed = [v - (v >> 63 << 64) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, pairs_up_to)
    found = {r.node: r.root for r in components.components(edges).collect()}
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                root[find(a)] = find(b)
    groups, mine = {}, {}
    for v in signed:
        groups.setdefault(find(v), set()).add(v)
        mine.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_spark_and_python_hash_shingles_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two thrée")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("one two thrée".encode(), 42)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0}
    assert {found[i] for i in range(1000, 1100)} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, mixed_rows):
    rows = [x for x in mixed_rows if x[0] is not None]
    kept = {r.doc_id for r in simhash.one_of_each_group(docs_of(spark, rows)).collect()}
    assert kept == {c for _, _, c in plain_components(rows, 2)}


def test_one_of_each_group_keeps_unlike_rows_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(k), "s0") for k in range(5)] + [(7, text(k), "s1") for k in range(5, 8)]
    rows += [(None, text(0), "s2"), (7, text(5), "s2"), (9, text(1), "s2"), (3, None, "s3"), (3, "", "s3"), (None, " ", "s3")]
    kept = simhash.one_of_each_group(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, (r.text or "").strip()) for r in kept), key=str) == sorted([(None, text(0)), (9, text(1)), (3, "")] + [(None, text(k)) for k in (2, 3, 4)] + [(7, text(k)) for k in (5, 6, 7)], key=str)
    assert len(kept) == len({fp for _, fp, _ in plain_components(rows, 2)}) == 9


def plain_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight, total, fixed = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}, sum(sizes.values()), {}
    while True:
        rest = [n for n in names if n not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[n] for n in rest) if rest else 0
        over = [n for n in rest if level * weight[n] > 3 * sizes[n]]
        if not over:
            return {n: fixed.get(n, level * weight[n]) for n in names}
        fixed |= {n: 3 * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 100}, {"é": 5, "z": 5, "Z": 500, "b": 0}, {"a": 0}])
def test_targets_match_repeated_sharing(spark, sizes):
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target, abs=1e-5) for r in found} == expected


def test_mixture_repeats_documents_near_their_target(spark):
    rows = [(i, "w " * 20, "abc"[i % 17 % 3] if i % 17 else None) for i in range(4000)] + [(9000, None, "a"), (9001, "", "b")]
    docs = docs_of(spark, rows).withColumn("size", F.lit("theirs"))
    plan = mixing.mixed(docs).collect()
    by = {}
    for r in plan:
        assert 0 <= r["copies"] <= 3
        by.setdefault(r.source, [0, r["target"]])[0] += r["copies"] * r["size"]
    assert all(abs(taken - target) < 0.1 * target for taken, target in by.values())
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in plan)
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))


def clashing(spark, rows):
    """Documents with a map and with columns named like those that operators make for themselves."""
    names = ["size", "target", "copies", "source_size", "rate", "goal_of", "again", "col", "__s", "__size", "own_sha", "own_points", "id", "sha", "points", "fp", "uid", "recipe", "shard", "kind", "turn", "toxic"]
    frame = docs_of(spark, rows)
    return frame.select("*", *[F.lit("theirs").alias(n) for n in names], F.create_map(F.lit("k"), F.col("doc_id")).alias("map"))


def test_clashing_columns_and_maps_pass_through(spark, mixed_rows):
    frame = clashing(spark, mixed_rows)
    for stage, plain in ((exact_dedup.without_exact_duplicates, None), (simhash.one_of_each_group, None), (mixing.mixture, None)):
        out = stage(frame)
        assert out.columns == frame.columns
        assert sorted(str((r.doc_id, norm(r.text))) for r in out.collect()) == sorted(str((r.doc_id, norm(r.text))) for r in stage(docs_of(spark, mixed_rows)).collect())
        assert {r["size"] for r in out.select("size").collect()} == {"theirs"}
    assert exact_dedup.exact_duplicates(frame).count() == simhash.near_duplicates(frame).count() == mixing.mixed(frame).count() == len(mixed_rows)


def test_null_ids_have_coins_of_their_own(spark):
    docs = docs_of(spark, [(None, f"word{i} " * 10, "a") for i in range(400)] + [(i, "w " * 10, "b") for i in range(400)])
    taken = [r.copies for r in mixing.mixed(docs).collect() if r.source == "a"]
    assert len(set(taken)) == 2


def test_a_group_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 5)
    rows = [(i, "the same text", "s") for i in range(300)] + [(1000 + i, f"text {i % 250}", "s") for i in range(600)]
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs_of(spark, rows)).collect()}
    assert len(found) == 900 and all(found[i].keep_id == 0 and found[i].group_size == 300 for i in range(300))
    assert all(found[1000 + i].keep_id == 1000 + i % 250 for i in range(600))


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert mixing.mixture(empty).count() == 0
