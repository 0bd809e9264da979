"""Ranked lexical search: a blocked sparse matrix product of items by terms and terms by documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from websheaf.llm.storage import table, written

#: Results an item.
K = 20
#: Bytes of item texts whose terms meet the documents in one pass; a longer item has a pass of its own.
ITEM_BYTES = 4_000_000
#: Postings of the documents that are multiplied at once, and bytes of a text that are split at once.
BLOCK_POSTINGS, PIECE = 2_000_000, 1 << 20
#: Shards in which the tasks' best rows meet before they meet an item's others.
SHARDS = 64
#: Fixed value: what a term is, as a translation of UTF-8 bytes: A-Z lower-cased, other ASCII but 0-9 and a-z to spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The text's terms in order, in lists of about PIECE bytes of text, cut between terms."""
    data, at = (text or b"").translate(TERM_BYTES), 0
    while at < len(data):
        to = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


@dataclass
class Items:
    """A block of items as a sparse matrix: row i has the terms terms[at[i]:at[i+1]], each with its multiplicity."""

    names: list[int | None]
    vocabulary: dict[bytes, int]
    at: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _matrix(rows: list[Row]) -> Items:
    vocabulary: dict[bytes, int] = {}
    at, terms, times = [0], [], []
    for row in rows:
        own = [vocabulary.setdefault(t, len(vocabulary)) for part in term_lists((row.text or "").encode()) for t in part]
        ids, n = np.unique(np.array(own, np.int64), return_counts=True)
        terms.append(ids)
        times.append(n.astype(np.int64))
        at.append(at[-1] + len(ids))
    return Items([r.item_id for r in rows], vocabulary, np.array(at), np.concatenate(terms), np.concatenate(times))


def _item_blocks(items: DataFrame, most: int) -> Iterator[Items]:
    """Blocks of at most `most` bytes of item texts, or of one item; the driver holds a block at a time."""
    rows, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((row.text or "").encode())
        if rows and size + n > most:
            yield _matrix(rows)
            rows, size = [], 0
        rows.append(row)
        size += n
    if rows:
        yield _matrix(rows)


def _postings(shared):
    """(doc_id, n, terms, tf) of each text: all its terms counted, and how often it has each of the asked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.vocabulary.get
        for batch in batches:
            texts, done = batch["text"].cast(pa.binary()), 0
            while done < len(batch):
                sizes, ids, counts, held, start = [], [], [], 0, done
                while done < len(batch) and held < BLOCK_POSTINGS:
                    n, found = 0, np.zeros(len(shared.value.vocabulary), np.int64)
                    for part in term_lists(texts[done].as_py()):
                        n += len(part)
                        known = np.fromiter((i for i in map(number, part) if i is not None), np.int64)
                        if len(known):
                            found += np.bincount(known, minlength=len(found))
                    own = np.flatnonzero(found)
                    sizes.append(n)
                    ids.append(own.astype(np.int32))
                    counts.append(found[own])
                    held += len(own) + 1
                    done += 1
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ids, counts)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(start, done - start), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """w * (10^9 tf div (1000 tf + 12 m)), m = 75 + (25 n N div L), in integers that hold every step."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 63:
        m = 75 + 25 * n * n_docs // length
    else:
        m = np.array([75 + 25 * int(x) * n_docs // length for x in n], np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _best(ids: np.ndarray, unnamed: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores in order, ties to the smaller id, null ids last."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], unnamed[at], -scores[at]))[:k]]


def product(items: Items, terms: np.ndarray, docs: np.ndarray, values: np.ndarray, n_docs: int) -> Iterator[np.ndarray]:
    """Rows of the product of `items` with the matrix of entries (terms, docs, values), one by one, dense over the docs of a block.

    Gustavson's way: row i of the product is the sum of the second matrix' rows at i's terms, each times its multiplicity.
    A term's row names each document once, so that adding it needs no sorting.
    """
    order = np.argsort(terms, kind="stable")
    docs, values = docs[order], values[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(items.vocabulary)))))
    for i in range(len(items.names)):
        row = np.zeros(n_docs, np.int64)
        for t, times in zip(items.terms[items.at[i] : items.at[i + 1]], items.times[items.at[i] : items.at[i + 1]]):
            here = slice(ends[t], ends[t + 1])
            row[docs[here]] += times * values[here]
        yield row


def _scores(shared, w: np.ndarray, n_docs: int, length: int, k: int):
    """(item, shard, doc_id, score): the k best of each item among the documents of a task, merged block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items.names)
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy()
            unnamed = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            each = np.diff(batch["terms"].offsets.to_numpy())
            terms, tf, n = batch["terms"].flatten().to_numpy(), batch["tf"].flatten().to_numpy(), batch["n"].to_numpy()
            values = impacts(tf, np.repeat(n, each), w[terms], n_docs, length)
            for i, row in enumerate(product(items, terms, np.repeat(np.arange(len(ids)), each), values, len(ids))):
                own, empty, scores = held[i]
                met = np.flatnonzero(row >= (scores[-1] if len(scores) == k else 1))
                if len(met):
                    own, empty, scores = np.concatenate((own, ids[met])), np.concatenate((empty, unnamed[met])), np.concatenate((scores, row[met]))
                    first = _best(own, empty, scores, k)
                    held[i] = own[first], empty[first], scores[first]
        shard = TaskContext.get().partitionId() % SHARDS
        item = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        own, empty, scores = map(np.concatenate, zip(*held))
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "shard": pa.array(np.full(len(item), shard), pa.int32()), "doc_id": pa.array(own, pa.int64(), mask=empty), "score": pa.array(scores, pa.int64())})

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _searched(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    postings = written(docs.mapInArrow(_postings(shared), "doc_id long, n long, terms array<int>, tf array<long>"), "postings")
    n_docs, length = postings.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(items.vocabulary), np.int64)
    for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        holding[term] = n
    w = weights(holding, n_docs)
    if int(items.times.sum()) * int(w.max(initial=0)) * 1_000_000 >= 1 << 63:
        raise OverflowError("an item's score could exceed 64 bits")
    found = postings.mapInArrow(_scores(shared, w, n_docs, length, k), "item int, shard int, doc_id long, score long")
    best = _ranked(_ranked(found, ["item", "shard"], k).drop("rank"), ["item"], k)
    names = spark.createDataFrame([(i, name) for i, name in enumerate(items.names)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(items: DataFrame, docs: DataFrame, *, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all `docs` (doc_id long, text string) for each row of `items` (item_id
    long, text string), scores above 0 only, ties to the smaller doc_id, null last; other columns are ignored.

    Items go in blocks of `item_bytes` of text, whose terms are sent to all executors. One pass over the whole texts writes
    the postings of those terms; the numbers of documents and terms, and the documents that hold each term, are counted
    from that table; then each task multiplies the items with blocks of its documents and keeps k rows an item, which
    meet in two steps. Rows of `items` are items of their own, rows of `docs` documents of their own, even where ids repeat.
    Null and empty texts hold no term: such items find nothing, and such documents count nowhere.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _item_blocks(items, item_bytes):
        part = _searched(source, block, k)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best `documents` for each row of `benchmark`. Null and empty texts take no part on either side; ties go to the smaller
    doc_id, null last; rows that repeat a doc_id or an item_id count each; empty tables give no rows; other columns are ignored."""
    return lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), b AS MATERIALIZED (
  SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL
), q AS (
  SELECT i, term, count(*)::BIGINT AS times FROM (SELECT i, unnest(terms) AS term FROM b) GROUP BY ALL
), p AS MATERIALIZED (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), v AS (
  SELECT p.r, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(d.terms) * n_docs) // total)))) AS impact
  FROM p JOIN d USING (r) JOIN w USING (term) CROSS JOIN s
), c AS (
  SELECT q.i, v.r, sum(q.times * v.impact)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL
), o AS (
  SELECT b.item_id, d.doc_id, score, (row_number() OVER (PARTITION BY c.i ORDER BY score DESC, d.doc_id NULLS LAST))::INTEGER AS rank
  FROM c JOIN b USING (i) JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
