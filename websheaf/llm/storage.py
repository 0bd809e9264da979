"""What the operators share: tables, the held-out rows, slices of texts, and joins that no large group holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.operators.shared import dropped, fresh, new_path, shared_folder, written

__all__ = ["HELD_OUT_REMAINDER", "LARGE", "dropped", "fresh", "held_out", "met", "new_path", "shared_folder", "table", "text_slices", "written"]

#: Groups of more than one in LARGE of all rows (so fewer than LARGE groups a row's key) meet their rows by broadcast.
LARGE = 500

#: A doc_id belongs to the held-out quarter when crc32(doc_id as text) mod 4 has this value.
HELD_OUT_REMAINDER = 2


def met(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of `rows` with `groups`, which has one row a key and in `size` its number of rows of `total`.

    No task gets a large group's rows: groups of more than one in LARGE of the rows are so few that they are broadcast, the
    others meet in a join. Both tables are read more than once and should be written ones.
    """
    large = F.col(size) > F.lit(max(1, total // LARGE))
    few = groups.filter(large)
    if few.isEmpty():
        return rows.join(groups, keys)
    hot, rest = F.broadcast(few), groups.filter(~large)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(values: list, limit: int = 4_000_000):
    """Ranges [a, b) of `values` holding about `limit` characters each, so that a task's memory does not follow the batch."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v) if v else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)
