"""Exact top-k by inner product: the threshold algorithm over lists sorted per dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websheaf.llm.storage import table

#: Results a query; every QUERY_STEP-th vec_id asks; components become floor(SCALE * x).
K, QUERY_STEP, SCALE = 5, 50, 256
#: Candidates and queries that meet in one task.
CANDIDATES, QUERIES = 8192, 4096
#: Ranks by which the lists are read further, at first; each later step reads as much as all before.
FIRST_DEPTH = 8

_OUT = "query_id long, vec_id long, score long, depth int"


def top_k(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the indices and scores of its k best points, best first, ties to the smaller id, and the depth read.

    `points` (n x d) and `queries` hold integers, of a type in which their products are exact; a point with the query's own
    id takes no part. Fagin's threshold algorithm: both sides are turned to the points' principal axes, which leaves inner
    products as they are and puts as much as possible of them into few coordinates. The d lists of points, each sorted by
    one coordinate (from the top where the query's is positive, from the bottom where negative), are read in step. Points
    met for the first time are scored whole, with the integers; no unmet point can score more than the sum of the products
    at the depth reached. Once that, with a margin for the turn's rounding, is under the kth score (not equal: a tie could
    hold a smaller id), the query is done. Nothing else ends a query but the lists' end.
    """
    n, d = points.shape
    wide = points.astype(np.float64)
    axes = np.linalg.eigh(wide.T @ wide)[1]
    turned, asked = wide @ axes, queries.astype(np.float64) @ axes
    order = np.argsort(turned, axis=0, kind="stable")
    ranked = np.take_along_axis(turned, order, axis=0)
    margin = 1e-12 * d * np.linalg.norm(asked, axis=1) * np.sqrt((wide * wide).sum(axis=1).max())
    depths = [min(n, FIRST_DEPTH)]
    while depths[-1] < n:
        depths.append(min(n, 2 * depths[-1]))
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    bounds = np.stack([up @ ranked[n - t] + down @ ranked[t - 1] for t in depths], axis=1) + margin[:, None]
    out = []
    for i, q in enumerate(queries):
        at, scores = np.zeros(0, np.int64), np.zeros(0, points.dtype)
        unmet = ids != own[i]
        rising, falling = asked[i] > 0, asked[i] < 0
        read = 0
        for step, depth in enumerate(depths):
            fresh = np.zeros(n, bool)
            fresh[order[n - depth : n - read, rising]] = True
            fresh[order[read:depth, falling]] = True
            if depth == n:
                fresh[:] = True
            new = np.flatnonzero(fresh & unmet)
            unmet[new] = False
            found = points[new] @ q
            if len(scores) == k:
                good = found >= scores[-1]
                new, found = new[good], found[good]
            at, scores = np.concatenate((at, new)), np.concatenate((scores, found))
            first = np.lexsort((ids[at], -scores))[:k] if len(at) <= 4 * k else _first(scores, ids[at], k)
            at, scores, read = at[first], scores[first], depth
            if len(scores) == k and bounds[i, step] < scores[-1]:
                break
        out.append((at, scores, read))
    return out


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group's rows; rows that repeat both id and vector count once."""
    if "vec_id" not in t.column_names or not t.num_rows:  # a side without rows comes without columns
        return np.zeros(0, np.int64), np.zeros((0, 0))
    ids = t["vec_id"].to_numpy()
    flat = t["v"].combine_chunks()
    x = flat.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    keep = np.lexsort((*x.T[::-1], ids))
    same = (ids[keep][1:] == ids[keep][:-1]) & (x[keep][1:] == x[keep][:-1]).all(axis=1)
    keep = keep[np.concatenate(([True], ~same))]
    return ids[keep], x[keep]


def _exact_type(points: np.ndarray, asked: np.ndarray) -> type:
    """Doubles where they hold every sum of products exactly, else 64-bit integers, which scores have to fit in."""
    most = lambda x: max(abs(int(x.max())), abs(int(x.min())))
    return np.float64 if points.shape[1] * most(points) * most(asked) < 1 << 53 else np.int64


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        (ids, points), (own, asked) = _matrix(candidates), _matrix(queries)
        if len(ids) and len(own):
            kind = _exact_type(points, asked)
            points, asked = points.astype(kind), asked.astype(kind)
        rows = [(own[i], ids[at], scores, depth) for i, (at, scores, depth) in enumerate(top_k(asked, points, ids, own, k))] if len(ids) and len(own) else []
        return pa.table(
            {
                "query_id": pa.array(np.concatenate([np.full(len(a), q) for q, a, *_ in rows]) if rows else [], pa.int64()),
                "vec_id": pa.array(np.concatenate([a for _, a, *_ in rows]) if rows else [], pa.int64()),
                "score": pa.array(np.concatenate([s for _, _, s, _ in rows]).astype(np.int64) if rows else [], pa.int64()),
                "depth": pa.array(np.concatenate([np.full(len(a), t) for _, a, _, t in rows]) if rows else [], pa.int32()),
            }
        )

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), x as double. Null ids, null vectors and vectors with null or non-finite
    components take no part, nor do empty ones."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def search(candidates: DataFrame, queries: DataFrame, *, k: int = K, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score, depth): each query's k best candidates other than itself, ties to the smaller vec_id;
    depth is how far the lists of the candidate's block were read.

    Both sides hold (vec_id, v); vectors meet those of their own length. A query with fewer candidates gets them all. Candidates and
    queries are hashed by id to blocks of bounded size, so that rows which repeat an id meet and count once, and each
    pair of blocks is one task's work; k rows per query and block meet in a window that ranks them.
    """
    n, m = candidates.count(), queries.count()
    blocks, groups = -(-n // block) or 1, -(-m // query_block) or 1

    def spread(df: DataFrame, own: str, parts: int, other: str, times: int) -> DataFrame:
        # aliases, as a cogroup of a table with a part of itself loses columns of the right side once a result column is unused
        placed = df.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(own))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    left = spread(candidates, "cb", blocks, "qb", groups).groupBy("cb", "qb", "d")
    right = spread(queries, "qb", groups, "cb", blocks).groupBy("cb", "qb", "d")
    found = left.cogroup(right).applyInArrow(_search(k), _OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of `embeddings` for each vector whose vec_id is divisible by 50. Rows with a null id, a null vector, null or
    non-finite components take no part; rows that repeat id and vector count once, those that share an id only are
    several vectors, none of which is a candidate of the others; ties go to the smaller vec_id; an empty table gives no
    rows; other columns are ignored."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0)).drop("depth")


OP1_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
