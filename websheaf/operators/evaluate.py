"""Evaluation reports: plateaus, configurations, methods, downloads, domain distributions, and the classes they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websheaf.functions.pages import citation_pdf, has_any
from websheaf.operators.quantiles import nearest_rank

#: What a paywalled page says.
PAYWALL = (
    "institutional login|institutional access|purchase article|buy this article|purchase access|sign in to read|log in to access|access options|get full access"
    "|full text is not available|subscribe to read|register to read|article access required"
).split("|")


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def plateau(sweep: DataFrame, by: str, gain: float = 0.05) -> DataFrame:
    """Per group over (delay, size): the first delay after which size grows by at most `gain`; zero sizes are passed over;
    the last delay where growth never stops."""
    w = Window.partitionBy(by).orderBy("delay")
    flat = F.when((F.col("size") > 0) & ((F.lead("size").over(w) - F.col("size")) / F.col("size") <= gain), F.col("delay"))
    rows = sweep.withColumn("flat", flat)
    return rows.groupBy(by).agg(F.coalesce(F.min("flat"), F.max("delay")).alias("delay"))


def configurations(pages: DataFrame) -> DataFrame:
    """Per config over (config, status, f1, recall, precision, byte_diff): median, least and largest F1, mean recall and
    precision, truncated median byte difference, failures (not ok, or F1 under 0.3), rows with a score and all rows."""
    return pages.groupBy("config").agg(
        F.round(F.coalesce(F.median("f1"), F.lit(0.0)), 6).alias("median_f1"), F.coalesce(F.min("f1"), F.lit(0.0)).alias("min_f1"), F.coalesce(F.max("f1"), F.lit(0.0)).alias("max_f1"),
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("mean_recall"), F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 6).alias("mean_precision"),
        F.coalesce(F.median(F.when(F.col("f1").isNotNull(), F.col("byte_diff"))).cast("int"), F.lit(0)).alias("median_byte_diff"),
        (count_if(F.col("status") != "ok") + count_if(F.col("f1") < 0.3)).alias("failed"), F.count("f1").alias("scored"), F.count("*").alias("n"),
    )


def shape_medians(pages: DataFrame) -> DataFrame:
    return pages.filter("f1 is not null").groupBy("config", "shape").agg(F.round(F.median("f1"), 6).alias("median_f1"))


def methods(scores: DataFrame) -> DataFrame:
    """Per method and mode: pairs, mean Jaccard, mean and nearest-rank 90 % latency."""
    keys = ["method", "mode"]
    means = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.round(F.avg("ms"), 4).alias("mean_ms"))
    return means.join(nearest_rank(scores, keys, F.col("ms"), [90]).withColumnRenamed("p90", "p90_ms"), keys, "left")


def download_outcome(status: Column, content_type: Column, body: Column) -> Column:
    """HTTP_n for errors, PDF_OK by type or by the first bytes, and for pages: a pdf link, a paywall, or neither."""
    low = F.lower(F.coalesce(body, F.lit("")))
    page = F.when(citation_pdf(body).isNotNull(), "HTML_HAS_PDF_LINK").when(has_any(low, PAYWALL), "HTML_PAYWALL").otherwise("HTML_OK")
    return F.when(status >= 400, F.concat(F.lit("HTTP_"), status.cast("string"))).when(content_type.contains("application/pdf") | body.startswith("%PDF"), "PDF_OK").when(content_type.contains("text/html"), page).otherwise("HTML_OK")


def paywall_mark(body: Column) -> Column:
    """The first of the marks that a page holds; null without one."""
    low = F.lower(body)
    return F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in PAYWALL])


def download_counts(rows: DataFrame, by: str) -> DataFrame:
    """Per group of (outcome): pdfs, pages by kind, client and server errors, and the share of pdfs."""
    o = F.col("outcome")
    out = rows.groupBy(by).agg(
        F.count("*").alias("n"), count_if(o == "PDF_OK").alias("pdf"), count_if(o == "HTML_HAS_PDF_LINK").alias("pdf_link"), count_if(o == "HTML_PAYWALL").alias("paywall"), count_if(o == "HTML_OK").alias("page"),
        count_if(o.startswith("HTTP_4")).alias("client_error"), count_if(o.startswith("HTTP_5")).alias("server_error"),
    )
    return out.withColumn("pdf_share", F.round(F.col("pdf") / F.col("n"), 6))


def burst_status(exit_code: Column, count: Column, domains: Column, stderr: Column) -> Column:
    """ERROR for a failed call; OK from 8 results of 5 domains on, fewer are SUSPECT; none: what the error output says."""
    none = F.when(stderr.contains("CAPTCHA detected"), "CAPTCHA").when(stderr.contains("Rate limited"), "RATE_LIMIT").when(stderr.contains("Google search failed"), "ERROR").otherwise("EMPTY")
    return F.when(exit_code != 0, "ERROR").when((count >= 8) & (domains >= 5), "OK").when(count > 0, "SUSPECT").otherwise(none)


def fetch_error(kind: Column, code: Column, elapsed: Column, message: Column, connect_s: float, read_s: float) -> Column:
    """Kind of a failed fetch: timeouts by elapsed time, else by their text; then resolve, proxy, connection and TLS errors."""
    timeout = (
        F.when(elapsed <= connect_s + 0.5, "connect_timeout").when(elapsed >= connect_s + read_s - 0.5, "read_timeout")
        .when(message.contains("Connection timed out"), "connect_timeout").when(message.contains("Operation timed out"), "read_timeout").otherwise("unknown")
    )
    return (
        F.when(kind == "timeout", timeout).when(code.isin(5, 6), "resolve_error").when((kind == "proxy") | code.isin(52, 8), "proxy_handshake_error")
        .when(kind == "connection", "connection_refused").when(kind == "ssl", "tls_error").otherwise("unknown")
    )


def domain_frequency(rows: DataFrame, least: int = 2) -> DataFrame:
    """Domains of (engine, query_id, domain) met at least `least` times: rows, engines, queries."""
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("engine").alias("engines"), F.countDistinct("query_id").alias("queries")).filter(F.col("n") >= least)


def missed_domains(rows: DataFrame, least: int = 2) -> DataFrame:
    """Domains of (domain, url, seq, marks) that no row of theirs has a mark for, with the first url seen."""
    out = rows.groupBy("domain").agg(F.count("*").alias("n"), F.max(F.size("marks")).alias("most"), F.min(F.struct("seq", "url"))["url"].alias("sample"))
    return out.filter((F.col("most") == 0) & (F.col("n") >= least)).select("domain", "n", "sample")


def variant_domains(rows: DataFrame, base: str, top: int = 15) -> DataFrame:
    """The `top` domains over all variants, with rows per variant, and whether the base variant lacks them."""
    out = rows.groupBy("domain").agg(F.count("*").alias("n"), count_if(F.col("variant") == base).alias("in_base"))
    return out.withColumn("new", F.col("in_base") == 0).orderBy(F.desc("n"), "domain").limit(top)


def byte_reduction(pages: DataFrame) -> DataFrame:
    """Per group over (grp, adopted, before, after): rows, adopters, their share, mean and median share of bytes saved where
    there were any."""
    saved = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before"))
    return pages.groupBy("grp").agg(F.count("*").alias("n"), count_if(F.col("adopted")).alias("adopted"), F.round(count_if(F.col("adopted")) / F.count("*"), 6).alias("share"), F.round(F.avg(saved), 6).alias("mean_saved"), F.round(F.median(saved), 6).alias("median_saved"))


def speedups(rows: DataFrame, baseline: str) -> DataFrame:
    """Per strategy: mean seconds, and how many times faster than the baseline's."""
    out = rows.groupBy("strategy").agg(F.avg("elapsed_s").alias("mean_s"))
    base = out.filter(F.col("strategy") == baseline).select(F.col("mean_s").alias("base_s"), F.lit(1).alias("__one"))  # one row
    return out.withColumn("__one", F.lit(1)).join(base, "__one").select("strategy", F.round("mean_s", 6).alias("mean_s"), F.round(F.col("base_s") / F.col("mean_s"), 6).alias("speedup"))


def rank_matrix(lists: DataFrame, names: list[str]) -> DataFrame:
    """Per (query, rank) the url of each method's list."""
    return lists.groupBy("query_id", "rank").pivot("method", names).agg(F.first("url"))


def path_class(domain: Column, url: Column, denied: list[str], trusted: list[str]) -> Column:
    return F.when(domain.isin(denied), "BLACKLIST").when(domain.isin(trusted), "TIER1").when(F.lower(url).endswith(".pdf"), "DIRECT").otherwise("MULTI_STEP")


def entry_rows(feed: DataFrame, site: str) -> DataFrame:
    """Feed rows (pathname, title, date) as entries: a path and a date of ten characters are needed; midnight UTC."""
    ok = feed.filter((F.coalesce("pathname", F.lit("")) != "") & (F.length("date") >= 10))
    day = F.left("date", F.lit(10))
    return ok.select(F.concat(F.lit(site), "pathname").alias("url"), F.concat(day, F.lit("T00:00:00Z")).alias("lastmod"), day.alias("publication_date"), "title")


def selection_totals(rows: DataFrame) -> DataFrame:
    """Counts of (source, cls, short) winners by source and class, by source, by class, and in all: null stands for any."""
    return rows.cube("source", "cls").agg(F.count("*").alias("n"), count_if(F.col("short")).alias("short_n"))


def clean_pass(entries: DataFrame, raw: DataFrame) -> DataFrame:
    """Entries (hash, url, publication_date) with their cleaned page (hash, body): file names, and what became of them."""
    out = entries.join(raw.select("hash", "body", F.lit(True).alias("__raw")), "hash", "left")
    state = F.when(F.col("__raw").isNull(), "missing").when(F.coalesce("body", F.lit("")) == "", "bodyless").otherwise("cleaned")
    name = F.concat(F.when(F.coalesce("publication_date", F.lit("")) == "", "unknown").otherwise(F.col("publication_date")), F.lit("__"), "hash", F.lit(".md"))
    return out.select("hash", "url", state.alias("state"), F.when(state == "cleaned", name).alias("file"))


def blocked_batches(batches: DataFrame, by: str) -> DataFrame:
    """Crawl batches (batch, blocked) with what the crawl does after them: go on, back off after a first blocked one, stop
    after a second in a row; batches past a stop are left out."""
    w = Window.partitionBy(by).orderBy("batch")
    hit = F.col("blocked") > 0
    again = hit & F.coalesce(F.lag("blocked").over(w) > 0, F.lit(False))
    rows = batches.withColumn("again", again)
    over = F.coalesce(F.max(F.col("again").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    action = F.when(F.col("again"), "stop").when(hit, "back off").otherwise("go on")
    return rows.withColumn("over", over).filter("over = 0").select(by, "batch", "blocked", action.alias("action"))
