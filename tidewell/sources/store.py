"""A stored table that is replaced whole by moving a pointer, and the use of a folder of files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.latest import last_rows


class DocumentStore:
    """A table in a folder that all executors share; each state is a folder of its own and the file ``current`` names the one that holds.

    A writer writes the new state aside, then a new pointer, and moves that over the old one in one step. A writer that dies before the move leaves
    the old state; what it wrote is never read and goes with a later ``tidy``. Readers see one whole state. One writer at a time.

    Per ``owner`` (all rows together if there is none) the newest ``keep`` rows stay, by ``order`` (nulls are oldest), then ``key``. Of the rows of a key, one that
    is written replaces the stored; of several in one write the newest stays, and ties go by the other columns, which must have an order. Rows without a key are one key of their owner.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, owner: list[str] | None = None, keep: int = 200):
        self.spark, self.path, self.key, self.order, self.owner, self.keep = spark, path.rstrip("/"), key, order, owner or [], keep
        jvm = spark._jvm.org.apache.hadoop.fs
        self._place = lambda name: jvm.Path(f"{self.path}/{name}")
        self.root = jvm.Path(self.path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The name of the state that holds; None if there is none, or the pointer names none that was written whole."""
        pointer = self._place("current")
        if not self.files.exists(pointer):
            return None
        stream = self.files.open(pointer)
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        return name if name.startswith("state-") and "/" not in name and self.files.exists(self._place(f"{name}/_SUCCESS")) else None

    def read(self) -> DataFrame | None:
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, rows: DataFrame) -> str:
        """Merges ``rows`` into the store and returns the new state's name. The first write sets the columns; later ones must have the same."""
        stored = self.read()
        rest = [c for c in rows.columns if c not in (self.key, self.order, *self.owner)]
        every = rows.withColumn("_new", F.lit(1))
        if stored is not None:
            every = stored.withColumn("_new", F.lit(0)).unionByName(every)
        keys = [*self.owner, self.key]
        newest = every.groupBy(*keys).agg(F.max(F.struct("_new", self.order, *rest)).alias("_row"))
        newest = newest.select(*keys, "_row.*").select(*rows.columns)
        order = [F.desc_nulls_last(self.order), F.desc_nulls_last(self.key)]
        # Without an owner the newest are found by a sort with a limit, which each task cuts before one task merges.
        kept = last_rows(newest, self.owner, order, self.keep) if self.owner else newest.orderBy(*order).limit(self.keep)
        name = f"state-{uuid4().hex}"
        kept.write.parquet(f"{self.path}/{name}")
        self._point(name)
        return name

    def _point(self, name: str) -> None:
        jvm = self.spark._jvm
        aside = self._place(f"pointer-{uuid4().hex}")
        stream = self.files.create(aside)
        stream.write(bytearray(name.encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(aside), context.makeQualified(self._place("current")), options)

    def tidy(self) -> int:
        """Deletes every state but the one that holds, and pointers never moved; how many went. Call it when no reader of an older state is left."""
        held, gone = self.current(), 0
        for status in self.files.listStatus(self.root) if self.files.exists(self.root) else []:
            name = status.getPath().getName()
            if name != held and name.startswith(("state-", "pointer-")):
                gone += bool(self.files.delete(status.getPath(), True))
        return gone


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of every file below a folder, without reading one; ``path`` is from the folder on."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.expr(f"substring(path, instr(path, '{sql_text(root)}/') + {len(root) + 1})")
    return files.select(inner.alias("path"), "length", F.col("modificationTime").alias("modified"))


def sql_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def folder_usage(files: DataFrame, areas: list[str], other: str, hours: float, now: Column) -> DataFrame:
    """Per area: ``files, bytes, oldest_hours, expired_files`` (older than ``hours`` at ``now``).

    A file's area is its first folder, if that is one of ``areas``, else ``other``; files beside the folders don't count. An area without files has
    zeros and no oldest age. ``files`` has the columns of ``file_table``.
    """
    first = F.substring_index("path", "/", 1)
    age = (F.unix_millis(now) - F.unix_millis("modified")) / 3_600_000
    rows = files.where(F.contains("path", F.lit("/"))).select(F.when(first.isin(areas), first).otherwise(other).alias("area"), "length", age.alias("age"))
    sums = rows.groupBy("area").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.round(F.max("age"), 1).alias("oldest_hours"), F.count_if(F.col("age") > hours).alias("expired_files")
    )
    every = files.sparkSession.createDataFrame([(x,) for x in dict.fromkeys([other, *areas])], "area string")
    return every.join(sums, "area", "left").na.fill(0, ["files", "bytes", "expired_files"])
