"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; that setting names storage every node reaches.

    Without the setting, and without a checkpoint folder set by the caller, there is no such place: an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/tidewell-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` of which no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """One side of a join, marked to be dealt by key: for tables that grow with the corpus, so that plans stay alike at every size."""
    return df.hint("merge")


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system behind a URI and the path in it, for code that runs inside tasks."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def slices(batches: Iterator[pa.RecordBatch], size_of, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``size_of(column values)`` stays near ``limit`` in each.

    A single row beyond the limit comes alone. ``size_of`` gets a batch and returns a size per row.
    """
    for batch in batches:
        start = total = 0
        for i, n in enumerate(size_of(batch)):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch) -> list[int]:
    """UTF-8 bytes of ``text`` in each row, 0 for null."""
    return pa.compute.binary_length(batch.column("text")).fill_null(0).to_pylist()
