"""Tables that several branches of a plan read: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, local sessions (tests) get a new
    temporary one; on a cluster, whose executors could not read it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="websheaf-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/websheaf/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage is cut, a lost executor loses nothing, and Spark knows its size.

    Tables that a returned DataFrame reads stay; clear `<spark.checkpoint.dir>/websheaf` once results are stored."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of what written() returned, once all that was made of it is written as well."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
