"""Writers.  Tables are Parquet unless a text format is the point."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from statuta.functions import vectors as V
from statuta.sources.scratch import filesystem

#: The folder of a null key, and rows that a task puts together from small files.
NULL_FOLDER, READ_ROWS = "__HIVE_DEFAULT_PARTITION__", 1 << 13

RETRIEVAL_COLUMNS = ["experiment", "query", "rank", "score", "chunk_text_snippet", "chunk_doc"]


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines: chunks, verdicts, gold rows, chunks by experiment."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One file, the best average first: a row for each experiment."""
    summary.orderBy(F.desc("avg_score"), "experiment").coalesce(1).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, vec_col: str = "vec", renormalise: bool = True, missing_is_empty: bool = True) -> DataFrame:
    """What write_vectors() wrote, as unit vectors if renormalise; no rows from a path that isn't there, if so asked."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_is_empty and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"id long, {vec_col} array<double>")
    found = spark.read.parquet(path)
    return found.withColumn(vec_col, V.unit(F.col(vec_col))) if renormalise else found


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that write_json() wrote."""
    return spark.read.schema(schema).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Two tables; with partition_by a folder for each of its values."""
    if partition_by:
        for name, df in (("nodes", nodes), ("edges", edges)):
            write_folders(df, f"{path}/{name}", partition_by)
        return
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_folders(df: DataFrame, path: str, key: str) -> None:
    """A folder key=value with one Parquet file for each value of an integer key.

    Tasks write the files in their places, so no folder is moved by the driver; a task
    that runs again writes the same names.
    """
    others = [c for c in df.columns if c != key]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        files = 0

        def write(value: int | None, parts: list[pa.RecordBatch]) -> None:
            folder = f"{root}/{key}={NULL_FOLDER if value is None else value}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/part-00000.parquet") as out:
                pq.write_table(pa.Table.from_batches(parts), out)

        last, parts = None, []
        for batch in batches:
            values = batch.column(0).to_pylist()
            rows = batch.select(others)
            first = 0
            for at in range(1, len(values) + 1):
                if at == len(values) or values[at] != values[first]:
                    if parts and last != values[first]:
                        write(last, parts)
                        parts, files = [], files + 1
                    last = values[first]
                    parts.append(rows.slice(first, at - first))
                    first = at
        if parts:
            write(last, parts)
            files += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([files], pa.int64())})

    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    df.select(key, *others).repartition(tasks, key).sortWithinPartitions(*([key, *others])).mapInArrow(task, "n long").agg(F.sum("n")).collect()


def read_folders(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """What write_folders() wrote: schema, key.  The driver lists only the folders' names; tasks open the files."""
    fs, root = filesystem(path)
    folders = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]
    tasks = max(1, min(len(folders), 3 * spark.sparkContext.defaultParallelism))
    whole = StructType([*schema.fields, StructField(key, LongType())])
    names = [f.name for f in schema.fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        held, n = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                shown = folder.partition("=")[2]
                value = None if shown == NULL_FOLDER else int(shown)
                with fs.open_input_file(f"{root}/{folder}/part-00000.parquet") as f:
                    rows = pq.ParquetFile(f).read(names, use_threads=False)
                held.append(rows.append_column(key, pa.array([value] * len(rows), pa.int64())))
                n += len(rows)
                if n >= READ_ROWS:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    listed = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())}))
    return listed.repartition(tasks, "folder").mapInArrow(task, whole)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
