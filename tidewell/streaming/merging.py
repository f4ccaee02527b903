"""Streams that end in a table of one row per key: micro-batches are merged once, however often they are sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A table of the latest row per ``key`` in a folder that all executors share.

    Rows lie in ``buckets`` parts by the key's hash. A batch writes the parts that it touches anew into a folder of its own, whose
    success file, written by Spark when all tasks are done, commits it; a part's newest committed folder holds its rows. So a writer that dies
    leaves the table as it was, a batch sent again after its commit changes nothing, and untouched parts are neither read nor written.
    One stream writes a table at a time, with batch numbers that rise.

    Of a key's rows the greatest by ``order`` stays, nulls first, then the greatest by the other columns, so late rows lose and ties don't
    depend on arrival; columns must be of types that have an order. Rows with a null key are one key. An empty batch commits nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.key, self.order, self.buckets, self.keep = spark, path.rstrip("/"), key, order, buckets, keep
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self, name: str, *parts: str) -> list[int]:
        """The numbers k of the folders ``name=k`` in a folder."""
        here = self._path(*parts)
        names = [s.getPath().getName() for s in self.files.listStatus(here)] if self.files.exists(here) else []
        return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{name}="))

    def committed(self) -> list[int]:
        return [k for k in self._numbers("batch") if self.files.exists(self._path(f"batch={k}", "_SUCCESS"))]

    def parts(self) -> dict[int, list[int]]:
        """The committed batches of each part, oldest first."""
        out: dict[int, list[int]] = {}
        for k in self.committed():
            for b in self._numbers("bucket", f"batch={k}"):
                out.setdefault(b, []).append(k)
        return out

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The rows, or those of some parts; None if there are no such parts yet."""
        paths = [f"{self.path}/batch={v[-1]}/bucket={b}" for b, v in self.parts().items() if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges the rows of batch ``number``, unless that was done before."""
        done = self.committed()
        if done and number <= done[-1]:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}
            if not touched:
                return
            old = self.read(touched)
            rows = batch if old is None else old.unionByName(batch)
            rest = [c for c in batch.columns if c != self.key and c not in self.order]
            latest = rows.groupBy(self.key).agg(F.max(F.struct(*self.order, *rest)).alias("row")).select(self.key, "row.*").select(*batch.columns)
            latest.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        finally:
            batch.unpersist()
        self._tidy()

    def _tidy(self) -> None:
        """Removes folders of parts beyond the newest ``keep``; readers of the last state finish undisturbed."""
        for b, batches in self.parts().items():
            for k in batches[: -self.keep]:
                self.files.delete(self._path(f"batch={k}", f"bucket={b}"), True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return self.merge


def progress_stream(items: DataFrame, totals: DataFrame, batch: str, failed: Column) -> DataFrame:
    """``batch, completed, failed, progress, status`` of the batches with new items, for update mode; ``totals`` (batch, total) is a table.

    A batch without a total has no progress and stays running. Spark keeps three numbers per batch as state.
    """
    marked = items.select(batch, F.coalesce(failed, F.lit(False)).cast("long").alias("failed")).join(totals.select(batch, "total"), batch, "left")
    rows = marked.groupBy(batch).agg(F.count("*").alias("completed"), F.sum("failed").alias("failed"), F.max("total").alias("total"))
    whole = F.col("completed") >= F.col("total")
    status = F.when(whole & (F.col("failed") == F.col("completed")), "failed").when(whole, "done").otherwise("running")
    return rows.select(batch, "completed", "failed", F.round(F.col("completed") / F.col("total"), 4).alias("progress"), status.alias("status"))
