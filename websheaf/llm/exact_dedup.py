"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websheaf.llm.chunking import chunk_ends
from websheaf.llm.storage import fresh, table, text_slices, written

#: Fixed value: the characters that normalisation deletes, [\x20\x09-\x0D].
DELETED = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of a chunk: least, mean of what follows, most.
CHUNK = (1024, 2048, 16384)
#: Groups of more than one in LARGE of all rows (so fewer than LARGE groups) meet their rows by broadcast.
LARGE = 500

_RECIPES = "uid long, doc_id long, n_points long, text_sha256 string, fps array<long>, digests array<binary>"


def _recipes(fingerprint_bits: int):
    kept = (1 << fingerprint_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("text_sha256", pa.string()), ("fps", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])
        for batch in batches:
            uids, ids, texts = batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()
            points = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
            for a, b in text_slices(texts):
                docs = [(t or b"").translate(None, DELETED) for t in texts[a:b]]
                data = b"".join(docs)
                bounds = np.cumsum([0, *map(len, docs)]).tolist()
                fps, digests, whole = [], [], []
                for start, ends, doc in zip(bounds, chunk_ends(np.frombuffer(data, np.uint8), bounds, *CHUNK), docs):
                    chunks = [data[x:y] for x, y in zip([start, *ends], ends)]
                    fps.append([(xxhash.xxh64_intdigest(c) & kept) - (1 << 63) for c in chunks])
                    digests.append([hashlib.sha256(c).digest() for c in chunks])
                    whole.append(hashlib.sha256(doc).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((uids[a:b], ids[a:b], points[a:b], whole, fps, digests), schema)], schema=schema)

    return run


def _with_verified_ids(recipes: DataFrame) -> DataFrame:
    """Adds `recipe`: the ordered identifiers of a document's chunks, equal for equal chunks and for no others.

    A chunk's identifier is its 64-bit fingerprint once every chunk of that fingerprint has shown the same SHA-256.
    Where fingerprints collide, all identifiers become (fingerprint, rank of the digest among its fingerprint's).
    """
    chunks = recipes.select("uid", F.posexplode(F.arrays_zip("fps", "digests")).alias("at", "c")).select("uid", "at", "c.*")
    distinct = chunks.select("fps", "digests").distinct()
    if distinct.groupBy("fps").count().filter("count > 1").isEmpty():
        return recipes.withColumn("recipe", F.col("fps"))
    ranks = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("fps").orderBy("digests")).cast("long"))
    named = chunks.join(ranks, ["fps", "digests"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "fps", "nth"))).alias("ids"))
    flat = F.flatten(F.transform("ids", lambda x: F.array(x["fps"], x["nth"])))
    return recipes.join(named, "uid", "left").withColumn("recipe", F.coalesce(flat, F.array().cast("array<long>"))).drop("ids")


def exact_duplicates(docs: DataFrame, *, fingerprint_bits: int = 64) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; other columns, whatever their names, are ignored).

    Returns doc_id, keep_id, group_size, kept, text_sha256, uid. Texts are equal when they are identical without the
    characters [\\x20\\x09-\\x0D]; null counts as empty, all empty texts are one group. Of a group the row with most code
    points in its original text stays, then the smallest doc_id (null last); of repeated rows exactly one stays.

    Each text is read and cut once; only 40 bytes a chunk move. Groups form on identifier lists with partial
    aggregation. What a group decides then meets its rows: fewer than LARGE large groups by broadcast, so that no task
    gets a large group's rows, the others in a join. `fingerprint_bits` under 64 exists to test collisions.
    """
    recipes, groups = _grouped(docs, fingerprint_bits)
    large = F.col("group_size") > F.lit(max(1, recipes.count() // LARGE))
    hot, rest = F.broadcast(groups.filter(large)), groups.filter(~large)
    joined = recipes.join(hot, "recipe").unionByName(recipes.join(hot.select("recipe"), "recipe", "left_anti").join(rest, "recipe"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "uid")


def _grouped(docs: DataFrame, fingerprint_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Two written tables: a row for each row of `docs`, and a row for each group of equal texts."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = source.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_recipes(fingerprint_bits), _RECIPES)
    recipes = _with_verified_ids(written(cut, "recipes"))
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg"), (-F.col("uid")).alias("neg_uid"), "text_sha256")).alias("best")
    groups = recipes.groupBy("recipe").agg(best, F.count("*").alias("group_size"))
    groups = groups.select("recipe", "group_size", (-F.col("best.neg")).alias("keep_id"), (-F.col("best.neg_uid")).alias("keep_uid"), F.col("best.n_points").alias("keep_points"), F.col("best.text_sha256").alias("keep_sha"))
    return recipes, written(groups, "groups")


def normalised_sha(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns unchanged, whatever their names and types.

    The documents meet only the ids that stay. Rows that repeat a doc_id (null ids among them) are told apart by text; of
    rows that repeat id, text without white space and length, one stays.
    """
    recipes, groups = _grouped(docs)
    kept = groups.select(F.col("keep_id").alias("id"), F.col("keep_sha").alias("sha"), F.col("keep_points").alias("points"))
    same_id = docs["doc_id"].cast("long").eqNullSafe(kept["id"])
    if recipes.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(kept, same_id, "left_semi")
    own, size = fresh(docs, "own_sha"), fresh(docs, "own_points")
    named = docs.withColumn(own, normalised_sha(F.col("text"))).withColumn(size, F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)))
    same = named["doc_id"].cast("long").eqNullSafe(kept["id"]) & (named[own] == kept["sha"]) & (named[size] == kept["points"])
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own, size)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`. Null texts count as empty, and all empty ones are a group; ties go to the smaller doc_id,
    null last; of repeated rows one is kept; an empty table gives no rows; other columns are ignored."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("uid")


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
