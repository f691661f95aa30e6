"""Intermediate tables in the shared folder that the session names.

A table is written and read again instead of cached, so that lost executors
cost no recomputation.  `spark.checkpoint.dir` names the folder; without it
tables go below the session's warehouse, which a cluster shares, too, and in
local mode (one machine) to a temporary folder that goes with the process.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/statuta-scratch"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="statuta-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet and read it again; cuts the lineage.  The shuffle files of the write go when it is done."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)  # an empty table has no file to take it from
    out.statuta_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.statuta_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the jobs run inside; the session's own comes back."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """At most so many rows in the Arrow batches of jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = int(spark.conf.get(name))
    with setting(spark, name, str(min(was, most) if was > 0 else most)):
        yield


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row's id and text: rows that repeat an id with another text, or have none, differ."""
    return F.xxhash64(docs[id_col], docs[id_col].isNull(), docs[text_col], F.length(docs[text_col]))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose row_key is in keys, a table of one column."""
    rows = docs.select(F.struct("*").alias("row"), row_key(docs).alias("key"))  # no name of docs can clash
    return rows.join(keys, F.col("key") == F.col(keys.columns[0]), "left_anti").select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shrink(spark: SparkSession) -> None:
    """Have executors collect their garbage and give free heap back to the system; their Python workers need the room."""
    cores = spark.sparkContext.defaultParallelism
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(collected.alias("done")).agg(F.count("done")).collect()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
