"""Whole-table order without a one-task window: rows are numbered inside buckets of their order key, and the buckets' totals,
a row each, give what comes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType

from websheaf.operators.shared import fresh

#: Neighbouring buckets, a power of two, that are summed before all are put in order.
SPAN = 1024


def numbered(df: DataFrame, bucket: Column, order: list, name: str = "nth", value: Column | None = None) -> DataFrame:
    """Adds the running sum of `value` (of 1: the row's number, from 1) in the order of (bucket, *order).

    `bucket` is a coarse, monotonic function of the order, such as the day of a time or seq div 10000.
    """
    b, v, t, base, coarse = (fresh(df, x) for x in ("bucket", "value", "total", "base", "coarse"))
    rows = df.withColumn(b, bucket).withColumn(v, F.lit(1).cast("long") if value is None else value.cast("long"))
    totals = _before(rows.groupBy(b).agg(F.sum(v).alias(t)), b, t, base, coarse)
    inside = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(totals, b).withColumn(name, F.col(base) + F.sum(v).over(inside)).drop(b, v, base)


def _before(totals: DataFrame, b: str, t: str, base: str, coarse: str) -> DataFrame:
    """(b, base): per bucket the sum of the totals of all buckets before it. Whole numbers and dates are put together by SPAN
    first, so that the one task that sees all of them has a row for SPAN neighbouring buckets, however fine these are. Its rows are
    dealt out again before they are joined: Spark would bring the other side, the whole table, to that one task."""
    kind = totals.schema[b].dataType
    whole = isinstance(kind, (ByteType, ShortType, IntegerType, LongType))
    up_to = lambda w: F.coalesce(F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not whole and not isinstance(kind, DateType):
        return totals.select(b, up_to(Window.orderBy(b)).alias(base)).repartition(b)
    number = F.col(b) if whole else F.unix_date(b)
    fine = totals.withColumn(coarse, F.shiftright(number.cast("long"), SPAN.bit_length() - 1))
    above = fine.groupBy(coarse).agg(F.sum(t).alias(t)).select(F.col(coarse).alias(base + "_of"), up_to(Window.orderBy(coarse)).alias(base)).repartition(base + "_of")
    inner = fine.withColumn(t, up_to(Window.partitionBy(coarse).orderBy(b)))
    return inner.join(above, F.col(coarse).eqNullSafe(F.col(base + "_of"))).select(b, (F.col(base) + F.col(t)).alias(base))


def gaps(df: DataFrame, bucket: Column, ts: str, order: list, name: str = "gap_s") -> DataFrame:
    """Adds the seconds since the row before, in the order of (bucket, *order); null for the first."""
    b, end, last = (fresh(df, x) for x in ("bucket", "end", "last"))
    rows = df.withColumn(b, bucket)
    inside = Window.partitionBy(b).orderBy(*order)
    earlier = Window.orderBy(b)
    ends = rows.groupBy(b).agg(F.max(ts).alias(end)).select(b, F.lag(end).over(earlier).alias(last)).repartition(b)  # else the rows come to the window's one task
    seen = F.coalesce(F.lag(ts).over(inside), F.col(last))
    return rows.join(ends, b).withColumn(name, F.col(ts).cast("double") - seen.cast("double")).drop(b, last)


def carried(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last `value` that is not null at or before each row, per `by` (the whole table if empty), in the order of
    (bucket, *order); null where there is none yet.

    Two levels: inside a key's bucket the rows are scanned, and what the buckets before leave comes from a scan over their last
    values, a row a bucket. So a key with a third of all rows is dealt over as many tasks as it has buckets.
    """
    b, v, last, known = (fresh(df, x) for x in ("bucket", "carry", "last", "known"))
    rows = df.withColumn(b, bucket).withColumn(v, F.when(value.isNotNull(), F.struct(*order, value.alias("value"))))
    ends = rows.groupBy(*by, b).agg(F.max(v).alias(last))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # over buckets
    ends = ends.select(*[F.col(c).alias(f"{known}_{c}") for c in by], F.col(b).alias(known), F.last(last, ignorenulls=True).over(before).alias(last)).repartition(*[f"{known}_{c}" for c in by], known)
    same = rows[b].eqNullSafe(ends[known])
    for c in by:
        same = same & rows[c].eqNullSafe(ends[f"{known}_{c}"])
    inside = Window.partitionBy(*by, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(last))
    return rows.join(ends, same).withColumn(name, found["value"]).drop(b, v, last, known, *[f"{known}_{c}" for c in by])


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, bucket, values: list[str], tie: str | None = None) -> DataFrame:
    """Backward as-of join: every row of `left` with `values` of the row of `right` that has its key and comes last at or
    before it by `on`; nulls where there is none. Among rows of `right` with equal `on` the one with the largest `tie` counts.

    `bucket` makes of a column a coarse, monotonic function of it (for times: F.to_date). Both sides are one scan, as in
    carried(), rather than a join on a range; rows of either side whose `on` is null find and give nothing.
    """
    side, at, held = (fresh(left, x) for x in ("side", "at", "held"))
    other = right.filter(F.col(on).isNotNull()).select(*by, F.col(on), F.lit(0).alias(side), (F.col(tie) if tie else F.lit(0)).cast("long").alias(at), F.struct(*values).alias(held))
    own = left.select(*by, F.col(on), F.lit(1).alias(side), F.lit(None).cast("long").alias(at), F.lit(None).cast(other.schema[held].dataType).alias(held), F.struct(*left.columns).alias("row"))
    both = other.withColumn("row", F.lit(None).cast(own.schema["row"].dataType)).unionByName(own)
    found = carried(both, by, bucket(F.col(on)), [on, side, at], F.col(held), "found").filter(F.col(side) == 1)
    return found.select("row.*", *[F.when(F.col(on).isNotNull(), F.col(f"found.{v}")).alias(v) for v in values])


def last_rows(df: DataFrame, bucket: Column, order: list, n: int) -> DataFrame:
    """The last n rows of the whole table, a top-n rather than a full sort."""
    return df.orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order]).limit(n)
