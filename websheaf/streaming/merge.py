"""Keyed tables that streams are merged into: copy on write by bucket, one manifest a version."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class _Folder:
    """Files of a path, through the file system that Spark reads it with."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._of(name))] if self.fs.exists(self._of(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._of(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or none of it: written beside, then renamed."""
        self.fs.mkdirs(self._of(name).getParent())
        stream = self.fs.create(self._of(f"{name}.part"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self._of(f"{name}.part"), self._of(name)):
            raise OSError(f"could not name {self.path}/{name}")

    def remove(self, name: str) -> None:
        self.fs.delete(self._of(name), True)


def _manifest(folder: _Folder, before: int | None = None) -> tuple[int, dict]:
    """The latest version (before a given one) and what it holds; -1 and an empty table if there is none."""
    versions = sorted(int(n.removesuffix(".json")) for n in folder.names("versions") if n.endswith(".json"))
    versions = [v for v in versions if before is None or v < before]
    return (versions[-1], json.loads(folder.read(f"versions/{versions[-1]}.json"))) if versions else (-1, {"schema": None, "buckets": {}})


def merge_into(path: str, keys: list[str], order: str, *, buckets: int = BUCKETS, first: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps, for each key, the row that comes last by `order`, with the columns named in
    `first` from the row that came first.

    The table lies in `buckets` parts by the keys' hash. A batch reads and writes the parts that its keys fall in, and no
    others; a manifest, renamed into place as the last step, says which files make the new version. A batch that runs again
    finds its manifest and does nothing; one that failed before that has left files that no manifest names, and overwrites
    them. Readers (current()) see whole versions only. Null keys are keys; ties by `order` go to the larger other columns.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = _Folder(spark, path)
        if f"{batch_id}.json" in folder.names("versions"):
            return
        _, table = _manifest(folder, batch_id)
        columns = batch.columns
        rest = [c for c in columns if c not in keys and c != order]
        placed = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # at most `buckets` numbers
        old = [table["buckets"][str(b)] for b in touched if str(b) in table["buckets"]]
        both = placed
        if old:
            schema = f"{table['schema']}, _bucket int"
            both = placed.unionByName(spark.read.schema(schema).option("basePath", f"{folder.path}/data").parquet(*[f"{folder.path}/data/{x}" for x in old]).select(*columns, "_bucket"))
        best = F.max(F.struct(order, *[c for c in rest if c not in first])).alias("last")
        begun = F.min(F.struct(order, *first)).alias("begun")
        merged = both.groupBy("_bucket", *keys).agg(best, begun)
        out = merged.select("_bucket", *[F.col(c) if c in keys else F.col(f"begun.{c}").alias(c) if c in first else F.col(f"last.{c}").alias(c) for c in columns])
        name = f"_version={batch_id}"
        out.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder.path}/data/{name}")
        kept = table["buckets"] | {str(b): f"{name}/_bucket={b}" for b in touched}
        folder.put(f"versions/{batch_id}.json", json.dumps({"schema": _ddl(batch), "buckets": kept}))

    return write


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's latest whole version."""
    folder = _Folder(spark, path)
    version, table = _manifest(folder)
    if version < 0:
        raise FileNotFoundError(f"no version in {path}")
    read = spark.read.schema(f"{table['schema']}, _version int, _bucket int").option("basePath", f"{folder.path}/data")
    return read.parquet(*[f"{folder.path}/data/{x}" for x in table["buckets"].values()]).drop("_version", "_bucket")


def vacuumed(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes the manifests but the last `keep`, and the parts that none of these names; how many parts went."""
    folder = _Folder(spark, path)
    versions = sorted(int(n.removesuffix(".json")) for n in folder.names("versions") if n.endswith(".json"))
    used = {x for v in versions[-keep:] for x in json.loads(folder.read(f"versions/{v}.json"))["buckets"].values()}
    for v in versions[:-keep]:
        folder.remove(f"versions/{v}.json")
    gone = 0
    for name in folder.names("data"):
        parts = [f"{name}/{p}" for p in folder.names(f"data/{name}") if p.startswith("_bucket=")]
        if name.startswith("_version=") and int(name.split("=")[1]) <= (versions[-1] if versions else -1):
            for p in parts:
                if p not in used:
                    folder.remove(f"data/{p}")
                    gone += 1
    return gone


def retained_in(path: str, days: int = 14) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends log rows (`ts` and others) under the day of their time and removes the days that lie wholly
    before the latest time seen less `days`. A batch that runs again overwrites its own files. Rows without a time, and
    rows that come too late for their day, are dropped; read with retained() for the exact bound."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = _Folder(spark, path)
        latest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        known = [int(n) for n in folder.names("latest")]
        newest = max([x for x in (latest, *known) if x is not None], default=None)
        if newest is None:
            return
        bound = F.timestamp_micros(F.lit(newest)) - F.make_interval(days=F.lit(days))
        rows = batch.filter(F.col("ts").isNotNull() & (F.col("ts") >= bound)).withColumn("_day", F.to_date("ts"))
        rows.write.mode("overwrite").partitionBy("_day").parquet(f"{folder.path}/data/_batch={batch_id}")
        first = batch.sparkSession.range(1).select(F.to_date(bound).cast("string")).first()[0]
        for name in folder.names("data"):
            for day in folder.names(f"data/{name}"):
                if day.startswith("_day=") and day.removeprefix("_day=") < first:
                    folder.remove(f"data/{name}/{day}")
        if newest not in known:
            folder.put(f"latest/{newest}", "")
        for x in known:
            if x < newest:
                folder.remove(f"latest/{x}")

    return write


def retained(spark: SparkSession, path: str, schema: str, days: int = 14) -> DataFrame:
    """What retained_in() keeps, to the row."""
    folder = _Folder(spark, path)
    newest = max(int(n) for n in folder.names("latest"))
    bound = F.timestamp_micros(F.lit(newest)) - F.make_interval(days=F.lit(days))
    return spark.read.schema(f"{schema}, _batch long, _day date").parquet(f"{folder.path}/data").drop("_batch", "_day").filter(F.col("ts") >= bound)
