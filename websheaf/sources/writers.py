"""Writers: appended logs, the search cache, sidecars, markdown files and listings."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websheaf.functions.pages import crawl_body

logger = logging.getLogger(__name__)


def append_log(rows: DataFrame, path: str) -> bool:
    """Appends rows as JSON lines, nulls as null and characters as they are; whether it did.

    A log does not stop the job that writes it: whatever goes wrong is a warning in the program's own log. Columns
    without a type are written as null strings. Spark commits the files of an append as a whole, so a failed one leaves no rows.
    """
    try:
        typed = rows.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in rows.dtypes if kind == "void"}) if "void" in dict(rows.dtypes).values() else rows
        typed.write.mode("append").option("ignoreNullFields", "false").json(path)
    except Exception as error:  # noqa: BLE001  any failure, also of the rows' own plan
        logger.warning("append to %s failed: %s", path, str(error).split("\n")[0])
        return False
    return True


def write_cache(entries: DataFrame, path: str) -> None:
    """Replaces the partitions of the keys written, and no others."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("search_key").parquet(path)


def write_by_year(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("year").parquet(path)


def sidecar(url: Column, ts: Column, engine: Column, outcome: Column, content_hash: Column, body: Column) -> Column:
    """Five comment lines and the body; null for empty content."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"<!-- {k}: "), v, F.lit(" -->")) for k, v in (("source", url), ("ts", ts), ("engine", engine), ("outcome", outcome), ("hash", content_hash))])
    return F.when(F.length(F.trim(body)) > 0, F.concat(head, F.lit("\n\n"), body))


def page_markdown(url: Column, text: Column) -> Column:
    """A crawled page as its file holds it."""
    return F.concat(F.lit("<!-- source: "), url, F.lit(" -->\n\n"), crawl_body(text))


def article_file(source: Column, date: Column, content_hash: Column) -> Column:
    return F.concat(source, F.lit("__"), date, F.lit("__"), content_hash, F.lit(".md"))


def facts(url: Column, status: Column, engine: Column, n_chars: Column, error: Column) -> Column:
    """What is known of an acquisition, before its content; facts that are missing are left out."""
    lines = [F.concat(F.lit("url: "), url), F.concat(F.lit("status: "), status.cast("string")), F.concat(F.lit("engine: "), engine), F.concat(F.lit("chars: "), n_chars.cast("string")), F.concat(F.lit("error: "), error)]
    return F.concat_ws("\n", *lines)
