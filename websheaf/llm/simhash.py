"""SimHash near-dedup: pigeonhole blocks, a join on blocks, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.components import components
from websheaf.llm.storage import fresh, met, table, written

#: Contract of the fingerprint: words a shingle, hash seed, and bits in which linked fingerprints may differ.
SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Two more blocks than bits may differ: any linked pair agrees on this many blocks less MAX_BITS.
EXTRA_BLOCKS = 2
#: Above so many fingerprints a block's pairs are not formed; its members meet at midpoints instead, which is as exact.
PAIRS_UP_TO = 64


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at [\x20\x09-\x0D] only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones, total, step = np.zeros(64, np.int64), len(words) - shingle_words + 1, 1 << 16
    for at in range(0, total, step):
        spans = zip(starts[at : min(at + step, total)].tolist(), ends[at + shingle_words - 1 : min(at + step, total) + shingle_words - 1].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            fps = [fingerprint(t or b"", shingle_words) for t in texts]
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in others), pa.array(fps, pa.int64())], [*others, "fp"])

    return run


def _masks(max_bits: int) -> list[int]:
    """Signed masks, each of some blocks of a 64-bit word: fingerprints within `max_bits` agree under at least one."""
    n = max_bits + EXTRA_BLOCKS
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(blocks, EXTRA_BLOCKS)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def links(fps: DataFrame, max_bits: int = MAX_BITS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within `max_bits` (an even number), and no others.

    `fps` holds distinct longs. In blocks of up to `pairs_up_to` members all pairs are compared. In larger ones each
    member emits every value within max_bits/2 of itself: members share a value exactly if they are within max_bits, so
    linking each value's members to its least member joins what the pairs would, with edges in proportion to the rows.
    """
    if max_bits % 2:
        raise ValueError("max_bits is an even number")
    masks = _masks(max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    shared = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keyed.join(shared, ["block", "key"]), "blocks")
    few = members.filter(F.col("n") <= pairs_up_to)
    other = few.select("block", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = few.join(other, ["block", "key"]).filter("fp > b").filter(near).select(F.col("fp").alias("a"), "b")
    flips = [0]
    for k in range(1, max_bits // 2 + 1):
        flips += [sum(c) - (1 << 64) if sum(c) >> 63 else sum(c) for c in combinations([1 << i for i in range(64)], k)]
    masked = F.element_at(F.array(*map(F.lit, masks)), F.col("block") + 1)
    inside = F.filter(F.array(*map(F.lit, flips)), lambda x: x.bitwiseAND(masked) == 0)
    many = members.filter(F.col("n") > pairs_up_to)
    mids = many.select("fp", "block", F.explode(F.transform(inside, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    least = mids.groupBy("block", "mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = mids.join(least, ["block", "mid"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; other columns are ignored): doc_id, fp, component_id.

    component_id is the smallest doc_id that is reachable through fingerprints within `max_bits` of each other, the
    document itself included (null only if all its component's doc_ids are null). Null and wordless texts have the
    fingerprint 0. Rows with equal fingerprints meet once, as a distinct fingerprint; copies are never paired.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(source.mapInArrow(_fingerprints(shingle_words), "doc_id long, fp long"), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    rooted = written(_rooted(distinct, max_bits, pairs_up_to), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "named")
    groups = written(met(rooted, named, ["root"], "n", rooted.count()).select("fp", "rows", "component_id"), "groups")
    return met(found, groups, ["fp"], "rows", found.count()).select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame, max_bits: int, pairs_up_to: int) -> DataFrame:
    """`distinct` (fp and other columns), a row for each fingerprint, with `root`, the root fingerprint of its component."""
    linked = components(links(distinct.select("fp"), max_bits, pairs_up_to))
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component of near copies, all columns unchanged.

    It is the row of the smallest doc_id, null last, then of the smallest SHA-256 of the text. Rows are told apart by
    doc_id and text: null and repeated doc_ids stand for as many documents as they have components. Of rows that
    repeat both (a null text counts as empty) one stays.
    """
    own = fresh(docs, "own_sha")
    named = docs.withColumn(own, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)))
    source = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(own).alias("sha"))
    found = written(source.mapInArrow(_fingerprints(SHINGLE_WORDS), "doc_id long, sha binary, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha")).alias("least")
    rooted = _rooted(found.groupBy("fp").agg(first), MAX_BITS, PAIRS_UP_TO)
    best = rooted.groupBy("root").agg(F.min("least").alias("least"))
    stay = written(best.select(F.col("least.doc_id").alias("id"), F.col("least.sha").alias("sha")), "stay")
    kept = named.join(stay, named["doc_id"].cast("long").eqNullSafe(stay["id"]) & (named[own] == stay["sha"]), "left_semi")
    repeats = found.groupBy("doc_id", "sha").count().filter("count > 1")
    return (kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", own])).drop(own)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`. Null and wordless texts have fingerprint zero and are linked like any other; rows that
    repeat an id each have their row; ties need no rule; an empty table gives no rows; other columns are ignored."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
