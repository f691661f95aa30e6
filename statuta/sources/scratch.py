"""Tables and files that a plan writes on its way, in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, else the warehouse, else (in local mode) a folder that goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/statuta-scratch"
    if not root:
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="statuta-files-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = f"file://{_local[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> str:
    """Write df as Parquet; returns its path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: what is costly to make is made once."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def stored_rows(path: str, most: int, columns: list[str] | None = None) -> Iterator[pa.Table]:
    """The rows of a table of stored(), read by a task, in the order of its files, most at a time."""
    fs, root = filesystem(path)
    held, n = [], 0
    for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
        with fs.open_input_file(file) as f:
            for batch in pq.ParquetFile(f).iter_batches(most, columns=columns, use_threads=False):
                while n + batch.num_rows >= most:
                    yield pa.Table.from_batches([*held, batch.slice(0, most - n)]).combine_chunks()
                    batch, held, n = batch.slice(most - n), [], 0
                if batch.num_rows:
                    held, n = [*held, batch], n + batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def write_files(files: DataFrame, folder: str) -> int:
    """Write rows (name, content) as files of a folder, from the executors; a task that runs again writes the same. Returns their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{path}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(task, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
