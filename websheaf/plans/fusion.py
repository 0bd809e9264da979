"""Fusion and ranking queries over the projected search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions.text import STOPWORDS
from websheaf.operators import fusion, ranking
from websheaf.operators.shared import written
from websheaf.plans.fixtures import DERIVED, ENGINES, load, results, sql

#: The sweep's values of b (with k1 1.2) and of k1 (with b 0.75).
SWEEP_B, SWEEP_K1 = (0.0, 0.4, 0.75, 1.0), (0.5, 0.8, 1.6, 2.0)
CLASSES = [("academic", ["crossref", "openalex", "semantic_scholar"]), ("qa", ["stack_exchange", "lobsters"])]

DERIVED |= {
    "pools": """SELECT r.query_id, r.url, r.engine AS owner, r.position, r.title, r.snippet, r.seq, p.engine_positions FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY position, engine, seq) AS n FROM results) r
  JOIN (SELECT query_id, url, string_agg(engine || '=' || position, ',' ORDER BY engine) AS engine_positions FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, url, engine ORDER BY seq DESC) AS n FROM results) WHERE n = 1 GROUP BY 1, 2) p
  ON p.query_id = r.query_id AND p.url = r.url WHERE r.n = 1""",
    "caps": """SELECT query_id, CASE WHEN count(*) FILTER (owner = 'google') > 0 THEN count(*) FILTER (owner = 'google') ELSE 10 END AS cap FROM pools GROUP BY query_id""",
    "capped": """SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.query_id, owner ORDER BY position, seq) AS rank FROM pools p) q JOIN caps USING (query_id) WHERE rank <= cap""",
    "by_engine": """SELECT query_id, url, engine, min(seq) AS first_seq, min(position) AS best,
    arg_max(snippet, seq) FILTER (snippet <> '') AS last_snippet FROM results GROUP BY ALL""",
    "bucket": """SELECT r.query_id, r.url, arg_min(r.snippet, r.seq) AS snippet, coalesce(arg_min(r.title, r.seq) FILTER (r.title <> ''), '') AS title,
    min(r.position) AS min_position, min(r.seq) AS seq FROM results r GROUP BY ALL""",
    "buckets": """SELECT b.*, e.engines, e.n_engines, e.positions, e.snippets, e.rrf FROM bucket b JOIN (
    SELECT query_id, url, string_agg(engine, ',' ORDER BY first_seq) AS engines, count(*) AS n_engines, string_agg(engine || '=' || best, ',' ORDER BY first_seq) AS positions,
    count(last_snippet) AS snippets, sum(1.0::DOUBLE / (best + 60)) AS rrf FROM by_engine GROUP BY ALL) e USING (query_id, url)""",
    "listed": "SELECT * FROM (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY n_engines DESC, min_position, seq) AS rank FROM buckets) l WHERE rank <= 10",
    "rrf_listed": "SELECT * FROM (SELECT query_id, url, round(rrf, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, seq) AS rank FROM buckets) l WHERE rank <= 10",
    "pool_docs": "SELECT b.query_id, b.url, b.seq, b.min_position, d.text FROM buckets b JOIN documents d ON d.doc_id = b.seq // 100000 % (SELECT count(*) FROM documents)",
    "query_texts": "SELECT query_id, arg_min(text, seq) AS query FROM pool_docs GROUP BY query_id",
    "doc_tokens": r"SELECT query_id, url, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS t FROM pool_docs",
    "doc_sizes": "SELECT query_id, avg(len(t)) AS avgdl, count(*) AS n_docs FROM doc_tokens GROUP BY query_id",
    "wanted": r"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}\p{M}_]+')) AS term FROM query_texts) q GROUP BY ALL",
    "term_hits": "SELECT query_id, url, dl, term, count(*) AS tf FROM (SELECT query_id, url, len(t) AS dl, unnest(t) AS term FROM doc_tokens) x GROUP BY ALL",
    "bm25": """SELECT d.query_id, d.url, round(coalesce(s.score, 0), 6) AS score FROM pool_docs d LEFT JOIN (
    SELECT query_id, url, sum(times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM term_hits JOIN wanted USING (query_id, term) JOIN doc_sizes USING (query_id) GROUP BY ALL) s USING (query_id, url)""",
    "slots": "SELECT query_id, engine, count(*) AS n FROM by_engine GROUP BY ALL",
}


def _pools(s: SparkSession, d: str) -> DataFrame:
    return fusion.engine_pools(results(s, d))


def _buckets(s: SparkSession, d: str) -> DataFrame:
    return fusion.bucket_pool(results(s, d))


def _pairs(m) -> F.Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def pool_docs(s: SparkSession, d: str) -> DataFrame:
    """Every bucket with the whole text of a document; documents are dealt to buckets over their whole table."""
    docs = load(s, d, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n_docs"), F.lit(1).alias("one"))  # one row
    dealt = _buckets(s, d).withColumn("one", F.lit(1)).join(n, "one").withColumn("doc_id", F.expr("seq div 100000 % n_docs"))
    return dealt.join(docs, "doc_id").select("query_id", "url", "seq", "min_position", "engines", "text")


def query_texts(pool: DataFrame) -> DataFrame:
    """A query's text is the whole text of its first pool row; only keys are aggregated."""
    first = pool.groupBy("query_id").agg(F.min("seq").alias("seq"))
    return pool.join(first, ["query_id", "seq"]).select("query_id", F.col("text").alias("query"))


def _pool_and_queries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = written(pool_docs(s, d), "pool")
    return pool, query_texts(pool)


def a01(s: SparkSession, d: str) -> DataFrame:
    return _pools(s, d).withColumn("engine_positions", _pairs("engine_positions"))


def a05(s: SparkSession, d: str) -> DataFrame:
    b = _buckets(s, d)
    return b.select("query_id", "url", "title", "snippet", F.array_join("engines", ",").alias("engines"), _pairs("positions").alias("positions"), F.size("snippets").cast("long").alias("snippets"), "min_position")


def a07(s: SparkSession, d: str) -> DataFrame:
    b = fusion.without_engines(_buckets(s, d), ["google", "bing"])
    return b.select("query_id", "url", F.array_join("engines", ",").alias("engines"), "min_position")


def _bm25(s: SparkSession, d: str) -> DataFrame:
    return ranking.bm25(*_pool_and_queries(s, d))


def _rrf_scores(s: SparkSession, d: str) -> DataFrame:
    return ranking.rrf_ranking(_buckets(s, d)).select("query_id", "url", "score")


def r08(s: SparkSession, d: str) -> DataFrame:
    kept = fusion.raw_cap(results(s, d)).select("query_id", "url").distinct()
    pool, asked = _pool_and_queries(s, d)
    return ranking.bm25(pool.join(kept, ["query_id", "url"], "left_semi"), asked)


def r07(s: SparkSession, d: str) -> DataFrame:
    """16 of (b, stopwords, representation) and 4 of k1; the url stands for the title, three times."""
    pool, asked = _pool_and_queries(s, d)
    settings = [ranking.Setting(1.2, b, weight, stop) for weight in (0, 3) for stop in (False, True) for b in SWEEP_B] + [ranking.Setting(k, 0.75) for k in SWEEP_K1]
    found = ranking.bm25_sweep(pool.withColumn("title", F.col("url")), asked, settings, stopwords=STOPWORDS)
    named = F.array(*[F.struct(F.lit(float(x.k1)).alias("k1"), F.lit(float(x.b)).alias("b"), F.lit("titled" if x.title_weight else "text").alias("representation"), F.lit(x.stopped).alias("stopwords")) for x in settings])
    return found.withColumn("c", F.get(named, "nth")).select("query_id", "url", "c.*", "score")


def r09_two_stages(s: SparkSession, d: str) -> DataFrame:
    """The best 50 of each pool by BM25, then 10 by cosine; a bucket's vector is dealt to it over the whole table."""
    vectors = load(s, d, "embeddings")
    n = vectors.agg(F.count("*").alias("n"), F.lit(1).alias("one"))  # one row
    pool, asked = _pool_and_queries(s, d)
    dealt = pool.withColumn("one", F.lit(1)).join(n, "one").withColumn("vec_id", F.expr("seq div 100000 % n")).join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").select("query_id", "url", "seq", "v")
    first = dealt.groupBy("query_id").agg(F.min(F.struct("seq", "v")).alias("m")).select("query_id", F.col("m.v").alias("q"))
    return ranking.reranked(ranking.bm25(pool, asked), dealt.select("query_id", "url", "v"), first).select("query_id", "url", "score", "rank")


def j16(s: SparkSession, d: str) -> DataFrame:
    listed = ranking.overlap_ranking(_buckets(s, d)).select("query_id", "url", "rank")
    backfill = ranking.rrf_ranking(_buckets(s, d)).select("query_id", "url", "rank")
    return fusion.cleaned_list(listed, fusion.raw_cap(results(s, d), "google", 3), backfill)


def r09(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    asked = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", F.col("embedding").alias("q")), "vec_id").select("label", "q", F.col("vec_id").alias("query_vec"))
    scored = e.join(asked, "label").withColumn("score", F.round(ranking.cosine(F.col("embedding"), F.col("q")), 5))
    return ranking.top_n(scored, 10, F.desc("score"), F.col("vec_id"), by=("label",)).select("label", "query_vec", "vec_id", "score", "rank")


def r13(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").cast("string").alias("url"), F.col("embedding").alias("values"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("indices"))
    e = e.withColumn("indices", F.filter("indices", lambda i: i % 3 == 0)).withColumn("values", F.transform("indices", lambda i: F.round(F.element_at("values", i + 1).cast("double"), 4)))
    asked = e.groupBy("query_id").agg(F.min(F.struct(F.col("url").cast("long").alias("u"), "indices", "values")).alias("q")).select("query_id", "q.indices", "q.values")
    return ranking.sparse_dot(e, asked)


def r14(s: SparkSession, d: str) -> DataFrame:
    replies = _buckets(s, d).select("query_id", "url", F.row_number().over(ranking.Window.partitionBy("query_id").orderBy("url")).alias("nth"))
    return ranking.selected_by_reply(_bm25(s, d), replies).select("query_id", "url", "rank")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "url", "rank")


def r15(s: SparkSession, d: str) -> DataFrame:
    a = ranking.overlap_ranking(_buckets(s, d)).groupBy("query_id").agg(F.collect_set("url").alias("a"))
    b = ranking.rrf_ranking(_buckets(s, d)).groupBy("query_id").agg(F.collect_set("url").alias("b"))
    return a.join(b, "query_id").select("query_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


QUERIES = {
    "a01_engine_pools": a01,
    "a02_pool_cap": lambda s, d: fusion.capped_pools(_pools(s, d)).select("query_id", "owner", "url", "position", "rank", "cap"),
    "a03_raw_cap": lambda s, d: fusion.raw_cap(results(s, d)).select("query_id", "engine", "url", "position", "seq"),
    "a04_breakdown": lambda s, d: fusion.breakdown(fusion.capped_pools(_pools(s, d)), ENGINES),
    "a05_bucket_pool": a05,
    "a06_engine_positions": lambda s, d: fusion.engine_positions(results(s, d)),
    "a07_without_engines": a07,
    "a13_slot_counts": lambda s, d: fusion.slot_counts(_buckets(s, d), CLASSES),
    "a15_query_distribution": lambda s, d: results(s, d).groupBy("query_id", "engine").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls")),
    "a22_top_domains": lambda s, d: fusion.domain_counts(results(s, d)),
    "j06_pool_diff": lambda s, d: fusion.pool_diff(results(s, d).filter("position <= 3"), results(s, d).filter("position >= 3")),
    "j07_jaccard": lambda s, d: fusion.jaccard(_ranked(ranking.overlap_ranking(_buckets(s, d))), _ranked(ranking.rrf_ranking(_buckets(s, d))), ["query_id"]).withColumn("jaccard", F.round("jaccard", 6)),
    "j08_gold_recall": lambda s, d: fusion.gold_recall(ranking.rrf_ranking(_buckets(s, d)), results(s, d).filter("position = 1")),
    "j11_co_occurrence": lambda s, d: fusion.co_occurrence(results(s, d)),
    "j16_cleaned_list": j16,
    "p01_engine_selection": lambda s, d: fusion.breakdown(_pools(s, d), fusion.selected_engines(ENGINES, " Bing, google,nosuch")),
    "r01_overlap": lambda s, d: _ranked(ranking.overlap_ranking(_buckets(s, d))),
    "r02_rrf": lambda s, d: ranking.rrf_ranking(_buckets(s, d)).select("query_id", "url", "score", "rank"),
    "r03_url_penalty": lambda s, d: ranking.penalty_ranking(_buckets(s, d)).select("query_id", "url", "penalty", "rank"),
    "r04_bm25": _bm25,
    "r05_bm25_okapi": lambda s, d: ranking.bm25(*_pool_and_queries(s, d), idf="okapi"),
    "r06_engine_inverse": lambda s, d: ranking.engine_inverse(_rrf_scores(s, d), _buckets(s, d)),
    "r07_bm25_sweep": r07,
    "r08_bm25_capped": r08,
    "r09_cosine": r09,
    "r09_two_stages": r09_two_stages,
    "r11_min_max": lambda s, d: ranking.min_max(_bm25(s, d)).select("query_id", "url", F.round("scaled", 6).alias("scaled")),
    "r12_hybrid": lambda s, d: ranking.hybrid(_rrf_scores(s, d), _bm25(s, d)),
    "r13_sparse_dot": r13,
    "r14_selected_by_reply": r14,
    "r15_list_overlap": r15,
    "t25_drilldown": lambda s, d: fusion.drilldown_text(fusion.capped_pools(_pools(s, d))),
    "w08_top_n": lambda s, d: ranking.top_n(_bm25(s, d), 5, F.desc("score"), F.col("url")).select("query_id", "url", "score", "rank"),
}

_PENALTY = r"""round(CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' THEN -0.5 ELSE 0 END
  + CASE WHEN contains(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/search/') THEN -0.3 ELSE 0 END
  - 0.1 * greatest(len(list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) - 4, 0), 6)::DOUBLE"""
_CLASS = """CASE WHEN regexp_matches(',' || engines || ',', ',(crossref|openalex|semantic_scholar),') THEN 'academic' WHEN regexp_matches(',' || engines || ',', ',(stack_exchange|lobsters),') THEN 'qa' ELSE 'general' END"""
_LISTS = "(SELECT query_id, url, 1 AS x FROM listed) a FULL JOIN (SELECT query_id, url, 1 AS y FROM rrf_listed) b USING (query_id, url)"
_SCALE = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_ALL_ENGINES = ", ".join(f"({i}, '{e}')" for i, e in enumerate(ENGINES))


def _breakdown_sql(table: str, names: str) -> str:
    return f"""SELECT q.query_id, e.engine, e.nth, count(p.url) AS n_urls FROM (SELECT DISTINCT query_id FROM {table}) q
  CROSS JOIN (VALUES {names}) e(nth, engine) LEFT JOIN {table} p ON p.query_id = q.query_id AND p.owner = e.engine GROUP BY ALL"""


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_SWEEPS = {}
for _name, _text in (("text", "text"), ("titled", "url || ' ' || url || ' ' || url || ' ' || text")):
    for _stop in (False, True):
        _k = f"{_name}_{int(_stop)}"
        _words = lambda x, stop=_stop: rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}_]+')" if not stop else rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: NOT list_contains({_STOP}, w))"
        _SWEEPS[f"toks_{_k}"] = f"SELECT query_id, url, {_words(_text)} AS t FROM pool_docs"
        _SWEEPS[f"sizes_{_k}"] = f"SELECT query_id, avg(len(t)) AS avgdl FROM toks_{_k} GROUP BY query_id"
        _SWEEPS[f"asked_{_k}"] = f"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_words('query')}) AS term FROM query_texts) q GROUP BY ALL"
        _SWEEPS[f"hits_{_k}"] = f"SELECT query_id, url, dl, term, count(*) AS tf FROM (SELECT query_id, url, len(t) AS dl, unnest(t) AS term FROM toks_{_k}) x GROUP BY ALL"


def _sweep_sql(name: str, stop: bool) -> str:
    k = f"{name}_{int(stop)}"
    grid = [(1.2, b) for b in SWEEP_B] + [(k1, 0.75) for k1 in SWEEP_K1] * (name == "text" and not stop)
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in grid)
    return f"""SELECT query_id, url, k1, b, round(sum(times * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) AS score, '{name}' AS representation, {str(stop).lower()} AS stopwords FROM hits_{k} JOIN asked_{k} USING (query_id, term)
  JOIN sizes_{k} USING (query_id) CROSS JOIN (VALUES {values}) g(k1, b) GROUP BY ALL"""


SQL = {
    "a01_engine_pools": sql("SELECT * FROM pools"),
    "a02_pool_cap": sql("SELECT query_id, owner, url, position, rank, cap FROM capped"),
    "a03_raw_cap": sql("""SELECT query_id, engine, url, position, seq FROM results JOIN (SELECT query_id, CASE WHEN count(*) FILTER (engine = 'google') > 0
  THEN count(*) FILTER (engine = 'google') ELSE 10 END AS cap FROM results GROUP BY query_id) c USING (query_id) WHERE position <= cap"""),
    "a04_breakdown": sql(_breakdown_sql("capped", _ALL_ENGINES)),
    "a05_bucket_pool": sql("SELECT query_id, url, title, snippet, engines, positions, snippets, min_position FROM buckets"),
    "a06_engine_positions": sql("SELECT query_id, url, engine, coalesce(min(position), 999) AS position FROM results GROUP BY ALL"),
    "a07_without_engines": sql("SELECT query_id, url, string_agg(engine, ',' ORDER BY first_seq) AS engines, min(best) AS min_position FROM by_engine WHERE engine NOT IN ('google', 'bing') GROUP BY ALL"),
    "a13_slot_counts": sql(f"""SELECT engine, count(*) AS total, count(*) FILTER (cls = 'academic') AS academic, count(*) FILTER (cls = 'qa') AS qa, count(*) FILTER (cls = 'general') AS general,
  count(*) FILTER (n_engines = 1) AS solo, count(*) FILTER (n_engines > 1) AS shared FROM by_engine JOIN (SELECT query_id, url, n_engines, {_CLASS} AS cls FROM buckets) b USING (query_id, url) GROUP BY engine"""),
    "a15_query_distribution": sql("SELECT query_id, engine, count(*) AS n, count(DISTINCT url) AS urls FROM results GROUP BY ALL"),
    "a22_top_domains": sql(r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY n DESC, domain) AS rank FROM (
  SELECT engine, regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) AS domain, count(*) AS n, count(DISTINCT query_id) AS queries FROM results GROUP BY ALL)) WHERE rank <= 15"""),
    "j06_pool_diff": sql("""SELECT query_id, count(*) FILTER (x = 1 AND y = 1) AS common, count(*) AS all_urls, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed,
  round_even(100 * count(*) FILTER (x = 1 AND y = 1) / count(*), 1)::DOUBLE AS overlap_pct FROM (SELECT DISTINCT query_id, url, 1 AS x FROM results WHERE position <= 3) a
  FULL JOIN (SELECT DISTINCT query_id, url, 1 AS y FROM results WHERE position >= 3) b USING (query_id, url) GROUP BY query_id"""),
    "j07_jaccard": sql(f"SELECT query_id, round(count(*) FILTER (x = 1 AND y = 1) / count(*), 6) AS jaccard FROM {_LISTS} GROUP BY query_id"),
    "j08_gold_recall": sql("""SELECT query_id, count(*) FILTER (f = 1 AND g = 1) AS matched, count(*) FILTER (f IS NULL) AS missing, count(*) FILTER (g IS NULL) AS noise,
  CASE WHEN count(g) > 0 THEN round_even(100 * count(*) FILTER (f = 1 AND g = 1) / count(g), 1) ELSE 0 END::DOUBLE AS recall_pct
  FROM (SELECT query_id, url, 1 AS f FROM rrf_listed) a FULL JOIN (SELECT DISTINCT query_id, url, 1 AS g FROM results WHERE position = 1) b USING (query_id, url) GROUP BY query_id"""),
    "j11_co_occurrence": sql("SELECT x.engine AS a, y.engine AS b, count(*) AS n FROM by_engine x JOIN by_engine y USING (query_id, url) WHERE x.engine <> y.engine GROUP BY ALL"),
    "j16_cleaned_list": sql("""SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS rank, replaced FROM (
  SELECT query_id, url, rank, NULL AS replaced FROM listed SEMI JOIN kept3 USING (query_id, url)
  UNION ALL SELECT f.query_id, f.url, f.i + 1000000000, l.url FROM (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS i FROM rrf_listed ANTI JOIN listed USING (query_id, url)) f
  JOIN (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS i FROM listed ANTI JOIN kept3 USING (query_id, url)) l USING (query_id, i)) z""",
        kept3="""SELECT DISTINCT query_id, url FROM results JOIN (SELECT query_id, CASE WHEN count(*) FILTER (engine = 'google') > 0 THEN count(*) FILTER (engine = 'google') ELSE 3 END AS cap FROM results GROUP BY query_id) c USING (query_id) WHERE position <= cap"""),
    "p01_engine_selection": sql(_breakdown_sql("pools", "(0, 'google'), (1, 'bing')")),
    "r01_overlap": sql("SELECT * FROM listed"),
    "r02_rrf": sql("SELECT * FROM rrf_listed"),
    "r03_url_penalty": sql(f"SELECT query_id, url, penalty, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY penalty DESC, min_position, seq) AS rank FROM (SELECT *, {_PENALTY} AS penalty FROM buckets)) WHERE rank <= 10"),
    "r04_bm25": sql("SELECT * FROM bm25"),
    "r05_bm25_okapi": sql("""SELECT d.query_id, d.url, round(coalesce(s.score, 0), 6) AS score FROM pool_docs d LEFT JOIN (
  SELECT query_id, url, sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM term_hits JOIN wanted USING (query_id, term) JOIN doc_sizes USING (query_id) JOIN idfs USING (query_id, term) GROUP BY ALL) s USING (query_id, url)""",
        raws="SELECT query_id, term, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT query_id, term, count(*) AS df FROM term_hits GROUP BY ALL) x JOIN doc_sizes USING (query_id)",
        idfs="SELECT query_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM raws"),
    "r06_engine_inverse": sql("SELECT query_id, url, round(score * weight, 6) AS score FROM rrf_listed JOIN (SELECT query_id, url, sum(1.0::DOUBLE / n) AS weight FROM by_engine JOIN slots USING (query_id, engine) GROUP BY ALL) w USING (query_id, url)"),
    "r07_bm25_sweep": sql(" UNION ALL ".join(_sweep_sql(name, stop) for name in ("text", "titled") for stop in (False, True)), **_SWEEPS),
    "r08_bm25_capped": sql("""SELECT d.query_id, d.url, round(coalesce(s.score, 0), 6) AS score FROM cd d LEFT JOIN (
  SELECT h.query_id, h.url, sum(times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM term_hits h SEMI JOIN cd USING (query_id, url) JOIN wanted USING (query_id, term) JOIN cs USING (query_id) GROUP BY ALL) s USING (query_id, url)""",
        cd="""SELECT * FROM pool_docs SEMI JOIN (SELECT query_id, url FROM results JOIN (SELECT query_id, CASE WHEN count(*) FILTER (engine = 'google') > 0 THEN count(*) FILTER (engine = 'google') ELSE 10 END AS cap FROM results GROUP BY query_id) c USING (query_id) WHERE position <= cap) k USING (query_id, url)""",
        cs="SELECT query_id, avg(len(t)) AS avgdl FROM doc_tokens SEMI JOIN cd USING (query_id, url) GROUP BY query_id"),
    "r09_cosine": """SELECT label, query_vec, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT e.label, q.vec_id AS query_vec, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e JOIN (
    SELECT * FROM embeddings SEMI JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label) m USING (vec_id)) q USING (label))) WHERE rank <= 10""",
    "r09_two_stages": sql("""SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, url) AS rank FROM (
  SELECT f.query_id, f.url, round(list_cosine_similarity(d.v::DOUBLE[], q.q::DOUBLE[]), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS n FROM bm25) f
  JOIN dealt d USING (query_id, url) JOIN (SELECT query_id, arg_min(v, seq) AS q FROM dealt GROUP BY query_id) q USING (query_id) WHERE n <= 50) x QUALIFY rank <= 10""",
        dealt="SELECT b.query_id, b.url, b.seq, e.embedding AS v FROM buckets b JOIN embeddings e ON e.vec_id = b.seq // 100000 % (SELECT count(*) FROM embeddings)"),
    "r11_min_max": sql(f"SELECT query_id, url, round({_SCALE}, 6) AS scaled FROM bm25 WINDOW w AS (PARTITION BY query_id)"),
    "r12_hybrid": sql(f"""SELECT query_id, url, round(0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0), 6) AS score FROM (SELECT query_id, url, {_SCALE} AS x FROM rrf_listed WINDOW w AS (PARTITION BY query_id)) a
  FULL JOIN (SELECT query_id, url, {_SCALE} AS y FROM bm25 WINDOW w AS (PARTITION BY query_id)) b USING (query_id, url)"""),
    "r13_sparse_dot": """WITH v AS (SELECT label AS query_id, vec_id::VARCHAR AS url, vec_id, i, round(embedding[i + 1]::DOUBLE, 4) AS x FROM embeddings, (SELECT unnest(range(0, 64, 3)) AS i))
SELECT v.query_id, v.url, round(sum(v.x * q.x), 8) AS score FROM v JOIN (SELECT * FROM v SEMI JOIN (SELECT min(vec_id) AS vec_id FROM v GROUP BY query_id) m USING (vec_id)) q ON v.query_id = q.query_id AND v.i = q.i GROUP BY ALL""",
    "r14_selected_by_reply": sql("""SELECT query_id, url, rank FROM (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS rank FROM (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY url) AS nth FROM buckets) r
  SEMI JOIN (SELECT query_id, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS n FROM bm25) WHERE n <= 20) b USING (query_id, url)) WHERE rank <= 10"""),
    "r15_list_overlap": sql("SELECT query_id, count(r.url) AS shared FROM listed l LEFT JOIN rrf_listed r USING (query_id, url) GROUP BY query_id"),
    "t25_drilldown": sql("""SELECT query_id, owner, string_agg(position || '. ' || title || chr(10) || '   URL: ' || url || CASE WHEN snippet <> '' THEN chr(10) || '   Snippet: ' || snippet ELSE '' END, chr(10) ORDER BY position, seq) AS listing FROM capped GROUP BY ALL"""),
    "w08_top_n": sql("SELECT * FROM (SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM bm25) WHERE rank <= 5"),
}
