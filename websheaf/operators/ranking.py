"""Rankers over fused pools: overlap, reciprocal rank, url penalties, BM25, cosine, sparse products, hybrids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websheaf.operators.shared import written

RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75


def top_n(scored: DataFrame, n: int, *order: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first n rows of each group in a stated order, as `rank`; the limit is pushed below the window's sort."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def overlap_ranking(pool: DataFrame, n: int = 10) -> DataFrame:
    """By number of engines, then best position, then arrival."""
    return top_n(pool.withColumn("n_engines", F.size("engines")), n, F.desc("n_engines"), F.col("min_position"), F.col("seq"))


def rrf(positions: Column, min_position: Column, k: int = RRF_K) -> Column:
    """Sum of 1 / (k + position) over engines; of the best position where none is known."""
    total = F.aggregate(F.map_values(positions), F.lit(0.0), lambda s, p: s + F.lit(1.0) / (p + k))
    return F.when(F.size(positions) > 0, total).otherwise(F.lit(1.0) / (min_position + k))


def rrf_ranking(pool: DataFrame, n: int = 10) -> DataFrame:
    scored = pool.withColumn("score", F.round(rrf(F.col("positions"), F.col("min_position")), 9))
    return top_n(scored, n, F.desc("score"), F.col("seq"))


def url_penalty(url: Column) -> Column:
    """-0.5 with a query string, -0.3 with a /search/ path, -0.1 for each path segment beyond four."""
    path = F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    query = F.when(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1) != "", F.lit(-0.5)).otherwise(0.0)
    return query + F.when(path.contains("/search/"), F.lit(-0.3)).otherwise(0.0) - F.lit(0.1) * F.greatest(depth - 4, F.lit(0))


def penalty_ranking(pool: DataFrame, n: int = 10) -> DataFrame:
    scored = pool.withColumn("penalty", F.round(url_penalty(F.col("url")), 6))
    return top_n(scored, n, F.desc("penalty"), F.col("min_position"), F.col("seq"))


def tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("(?U)\\b\\w+\\b"), 0)
    if not stopwords:
        return found
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(found, lambda t: ~F.array_contains(stop, t))


def representation(title: Column, snippet: Column, title_weight: int = 1) -> Column:
    """Title (repeated) and snippet as one text."""
    return F.concat_ws(" ", *[title] * title_weight, snippet)


@dataclass(frozen=True)
class Setting:
    """A way to score: BM25's k1 and b, how often a document's title counts beside its text, and whether stop words count."""

    k1: float = BM25_K1
    b: float = BM25_B
    title_weight: int = 0
    stopped: bool = False


def _term_counts(docs: DataFrame, queries: DataFrame, settings: list[Setting], stopwords: list[str]) -> tuple[DataFrame, DataFrame]:
    """What each query's terms count in each document of its corpus (query_id, url, term, times, tf_text, tf_title, and for
    every kind of length i dl_i and avg_i); and corpus sizes (query_id, n_docs, avg_i).

    A document is tokenised once and dealt by its own key, so that all counting and summing by document happens where its
    tokens are; only documents and the queries' terms are shuffled. Terms that no query asks for go before they are counted.
    """
    titled = any(s.title_weight for s in settings)
    kept = lambda ts: F.filter(ts, lambda t: ~t.isin(stopwords)) if stopwords else ts
    split = docs.select("query_id", "url", tokens(F.col("text")).alias("body"), (tokens(F.col("title")) if titled else F.array().cast("array<string>")).alias("head"))
    size = lambda c, stopped: F.size(kept(F.col(c)) if stopped else F.col(c))
    kinds = _kinds(settings)
    lengths = [(size("body", stopped) + (weight * size("head", stopped) if weight else 0)).alias(f"dl_{i}") for i, (weight, stopped) in enumerate(kinds)]
    rows = written(split.select("*", *lengths), "tokens")
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("n_docs"), *[F.avg(f"dl_{i}").alias(f"avg_{i}") for i in range(len(kinds))])
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = written(asked.join(sizes, "query_id"), "asked")
    every = rows.repartition("query_id", "url").select("query_id", "url", *[f"dl_{i}" for i in range(len(kinds))], F.explode(F.concat(_flagged("body", 0), _flagged("head", 1)) if titled else _flagged("body", 0)).alias("e"))
    every = every.select("*", "e.term", "e.title").drop("e")
    fixed = ["query_id", "url", "term", "times", "n_docs", *[f"{x}_{i}" for i in range(len(kinds)) for x in ("dl", "avg")]]
    hits = every.join(asked, ["query_id", "term"]).groupBy(*fixed).agg(F.sum(1 - F.col("title")).alias("tf_text"), F.sum("title").alias("tf_title"))
    return hits, rows


def _kinds(settings: list[Setting]) -> list[tuple[int, bool]]:
    return sorted({(s.title_weight, s.stopped) for s in settings})


def _flagged(column: str, title: int) -> Column:
    return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(title).alias("title")))


def _part(s: Setting, kinds: list[tuple[int, bool]], idf: Column, stopwords: list[str]) -> Column:
    """A term's part of a document's score; null where the setting does not see the term."""
    i = kinds.index((s.title_weight, s.stopped))
    tf = F.col("tf_text") + (s.title_weight * F.col("tf_title") if s.title_weight else 0)
    norm = tf + F.lit(s.k1) * (1 - F.lit(s.b) + F.lit(s.b) * F.col(f"dl_{i}") / F.col(f"avg_{i}"))
    seen = (tf > 0) & (~F.col("term").isin(stopwords) if s.stopped and stopwords else F.lit(True))
    return F.when(seen, F.col("times") * idf * tf * (F.lit(s.k1) + 1) / norm)


def bm25(docs: DataFrame, queries: DataFrame, *, k1: float = BM25_K1, b: float = BM25_B, idf: str = "uniform", stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, url, score) of each pool row (query_id, url, text) against its query (query_id, query); a query's pool
    is its corpus.

    idf `uniform` counts every term of the corpus 1; `okapi` is log((N - n + 0.5) / (n + 0.5)) with negative values
    replaced by a quarter of the corpus' mean, for which all terms of the corpus are counted.
    """
    setting, stop = Setting(k1, b, 0, bool(stopwords)), list(stopwords or [])
    hits, rows = _term_counts(docs, queries, [setting], stop)
    weight = F.lit(1.0)
    if idf == "okapi":
        every = rows.select("query_id", F.explode(F.array_distinct("body")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
        every = every.filter(~F.col("term").isin(stop)) if stop else every
        raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        every = written(every.join(rows.groupBy("query_id").agg(F.count("*").alias("n_docs")), "query_id").select("query_id", "term", raw.alias("raw")), "terms")
        floor = every.groupBy("query_id").agg((0.25 * F.avg("raw")).alias("floor"))
        hits = hits.join(every, ["query_id", "term"]).join(floor, "query_id")
        weight = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    scored = hits.groupBy("query_id", "url").agg(F.sum(_part(setting, _kinds([setting]), weight, stop)).alias("score"))
    return rows.select("query_id", "url").join(scored, ["query_id", "url"], "left").select("query_id", "url", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def bm25_sweep(docs: DataFrame, queries: DataFrame, settings: list[Setting], *, stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, url, nth, score): BM25 under every setting (nth, from 0) for the documents (query_id, url, text, and title if a
    setting counts it) in which it sees a term of their query. One pass counts terms in texts and titles apart; titles,
    stop words, k1 and b are arithmetic over those counts."""
    stop, kinds = list(stopwords or []), _kinds(settings)
    hits, _ = _term_counts(docs, queries, settings, stop)
    parts = [F.sum(_part(s, kinds, F.lit(1.0), stop)).alias(f"s{n}") for n, s in enumerate(settings)]
    scored = hits.groupBy("query_id", "url").agg(*parts)
    each = F.array(*[F.struct(F.lit(n).alias("nth"), F.round(f"s{n}", 6).alias("score")) for n in range(len(settings))])
    return scored.select("query_id", "url", F.explode(each).alias("e")).select("query_id", "url", "e.nth", "e.score").filter("score is not null")


def reranked(scored: DataFrame, vectors: DataFrame, queries: DataFrame, *, first: int = 50, n: int = 10) -> DataFrame:
    """Two stages: each query's `first` best rows of `scored` (query_id, url, score) by score, then the n best of them by the
    cosine of their vector (query_id, url, v) with the query's (query_id, q), as (query_id, url, score, rank). Ties go by
    url; rows without a vector come last, with a null score. Vectors of other rows are not compared."""
    best = top_n(scored, first, F.desc("score"), F.col("url")).select("query_id", "url")
    rows = best.join(vectors, ["query_id", "url"], "left").join(queries, "query_id", "left")
    again = rows.select("query_id", "url", F.round(cosine(F.col("v"), F.col("q")), 5).alias("score"))
    return top_n(again, n, F.col("score").desc_nulls_last(), F.col("url"))


def engine_inverse(scored: DataFrame, pool: DataFrame) -> DataFrame:
    """Scores times the sum, over a row's engines, of 1 / (slots that the engine holds for the query)."""
    flat = pool.select("query_id", "url", F.explode("engines").alias("engine"))
    slots = flat.groupBy("query_id", "engine").agg(F.count("*").alias("n"))
    weight = flat.join(slots, ["query_id", "engine"]).groupBy("query_id", "url").agg(F.sum(1 / F.col("n")).alias("weight"))
    return scored.join(weight, ["query_id", "url"]).select("query_id", "url", F.round(F.col("score") * F.col("weight"), 6).alias("score"))


def min_max(scored: DataFrame, column: str = "score", by: str = "query_id") -> DataFrame:
    """Scores scaled to [0, 1] per group; 0.5 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return scored.withColumn("scaled", F.when(high == low, 0.5).otherwise((F.col(column) - low) / (high - low)))


def hybrid(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """Weighted sum of two min-max scaled scorings (query_id, url, score); a missing side counts 0."""
    x = min_max(a).select("query_id", "url", F.col("scaled").alias("x"))
    y = min_max(b).select("query_id", "url", F.col("scaled").alias("y"))
    both = x.join(y, ["query_id", "url"], "full_outer")
    score = weight * F.coalesce("x", F.lit(0.0)) + (1 - weight) * F.coalesce("y", F.lit(0.0))
    return both.select("query_id", "url", F.round(score, 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def sparse_dot(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, url, score) of sparse vectors (query_id, url, indices, values) with their query's (query_id, indices,
    values), through a join on (query, index)."""
    left = docs.select("query_id", "url", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("query_id", "url", F.col("e.indices").alias("i"), F.col("e.values").alias("x"))
    right = queries.select("query_id", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("query_id", F.col("e.indices").alias("i"), F.col("e.values").alias("y"))
    return left.join(right, ["query_id", "i"]).groupBy("query_id", "url").agg(F.round(F.sum(F.col("x") * F.col("y")), 8).alias("score"))


def selected_by_reply(scored: DataFrame, replies: DataFrame, shown: int = 20, kept: int = 10) -> DataFrame:
    """What an outside selector named: of the `shown` best rows only, in the reply's order, at most `kept`."""
    best = top_n(scored, shown, F.desc("score"), F.col("url")).select("query_id", "url")
    return top_n(replies.join(best, ["query_id", "url"], "left_semi"), kept, F.col("nth"))


def scored_externally(pool: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """A ranking by scores that come as a table (query_id, url, score), such as a cross-encoder's."""
    return top_n(pool.join(scores, ["query_id", "url"]), n, F.desc("score"), F.col("seq"))
