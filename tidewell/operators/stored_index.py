"""A stored gram index: opened by signature, refreshed by changed documents only, searched without reading texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import padded
from tidewell.operators import scoring
from tidewell.operators.retrieval import idf

#: Versions that stay: the one in use and the one before, which a search may still read.
KEPT_VERSIONS = 2
PARTS = ("documents", "grams", "meta")


class Refresh(NamedTuple):
    """What a refresh did: ``built``, ``updated`` or ``unchanged``, and how many documents were new, changed and gone."""

    action: str
    n_docs: int
    n_new: int
    n_changed: int
    n_gone: int


def folder(spark: SparkSession, path: str):
    """The file system of a path and its own name for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first. A version counts once its ``meta``, written last, is whole; what a broken refresh left behind doesn't."""
    fs, place = folder(spark, f"{path}/meta")
    if not fs.exists(place):
        return []
    names = (s.getPath().toString() for s in fs.listStatus(place))
    return sorted(int(n.rsplit("version=", 1)[1]) for n in names if "version=" in n and fs.exists(folder(spark, f"{n}/_SUCCESS")[1]))


def part(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}/version={version}")


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, rank, mark, gram, tf``: each document's gram numbers and how often they come, as two arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in scoring.portions([batch], 64):
                pairs = [np.unique(scoring.gram_codes(t or ""), return_counts=True) for t in piece.column("padded").to_pylist()]
                arrays = [pa.array([p[i] for p in pairs], pa.list_(pa.int64() if i == 0 else pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "rank", "mark")), *arrays], ["doc_id", "rank", "mark", "gram", "tf"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "rank", "mark"))
    return docs.select("doc_id", "rank", "mark", "padded").mapInArrow(run, f"{kinds}, gram array<bigint>, tf array<int>")


def with_norms(rows: DataFrame, grams: pa.Table, n_docs: int) -> DataFrame:
    """``rows`` with ``norm``, worked out where a document's grams lie, so that none are shuffled; ``grams`` (gram, df) are sent to the tasks."""
    order = np.argsort(grams.column("gram").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((grams.column("gram").to_numpy()[order], np.log((1 + n_docs) / (1 + grams.column("df").to_numpy()[order])) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shared.value
        for batch in scoring.portions(batches):
            lists = batch.column("gram")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            weight = (1 + np.log(batch.column("tf").flatten().to_numpy())) * value[np.searchsorted(known, lists.flatten().to_numpy())]
            yield batch.append_column("norm", pa.array(np.sqrt(np.bincount(row, weight * weight, batch.num_rows)), pa.float64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, norm double")


def refresh(docs: DataFrame, path: str) -> Refresh:
    """Bring the index in ``path`` up to ``docs`` (doc_id, text, and rank, a number for ties).

    One scan takes the signature: the number of documents and a hash over all. If the stored one is the same, nothing is done. Else only new and changed
    texts are cut into grams; the document counts of grams take the difference of what came and went; norms, which depend on all counts,
    follow from the stored grams. A new version is written beside the old one and counts from when its last part is complete, so a refresh
    that breaks off leaves the index as it was. doc_id tells documents apart; a null one is not indexed; a null text has the grams of an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.where("doc_id is not null").select("doc_id", "rank", padded(text).alias("padded"), F.sha1(F.concat_ws(":", F.col("rank").cast("string"), text)).alias("mark"))
    n, signature = marked.agg(F.count("*"), F.bit_xor(F.xxhash64("doc_id", "mark"))).first()
    done = versions(spark, path)
    old = part(spark, path, "documents", done[-1]) if done else None
    if old is not None:
        stored = part(spark, path, "meta", done[-1]).first()
        if (stored["n_docs"], stored["signature"]) == (n, signature):
            return Refresh("unchanged", n, 0, 0, 0)
    version = done[-1] + 1 if done else 0
    fs, _ = folder(spark, path)
    for name in PARTS:
        # Remains of a refresh that broke off.
        fs.delete(folder(spark, f"{path}/{name}/version={version}")[1], True)

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}/{name}/version={version}")
        return part(spark, path, name, version)

    if old is None:
        fresh, left, n_new, n_changed, n_gone = marked, None, n, 0, 0
        rows = counted(fresh)
    else:
        both = marked.select("doc_id", F.col("mark").alias("new")).join(old.select("doc_id", F.col("mark").alias("old")).hint("merge"), "doc_id", "full")
        kind = F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("new") != F.col("old"), "changed").otherwise("same")
        kinds = store(both.select("doc_id", kind.alias("kind")), "kinds")
        sums = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
        n_new, n_changed, n_gone = (sums.get(k, 0) for k in ("new", "changed", "gone"))
        fresh = marked.join(kinds.where("kind in ('new', 'changed')").hint("merge"), "doc_id", "left_semi")
        left = old.join(kinds.where("kind in ('gone', 'changed')").hint("merge"), "doc_id", "left_semi")
        rows = counted(fresh).unionByName(old.join(kinds.where("kind = 'same'").hint("merge"), "doc_id", "left_semi").drop("norm"))
    rows = store(rows, "rows")
    if old is None:
        grams = rows.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    else:
        came = rows.join(kinds.where("kind in ('new', 'changed')").hint("merge"), "doc_id", "left_semi")
        changes = came.select(F.explode("gram").alias("gram"), F.lit(1).cast("long").alias("df")).unionByName(left.select(F.explode("gram").alias("gram"), F.lit(-1).cast("long").alias("df")))
        grams = part(spark, path, "grams", done[-1]).unionByName(changes.groupBy("gram").agg(F.sum("df").alias("df"))).groupBy("gram").agg(F.sum("df").alias("df")).where("df > 0")
    grams = store(grams, "grams")
    found = grams.limit(scoring.SENT_ROWS + 1).toArrow()
    if found.num_rows <= scoring.SENT_ROWS:
        store(with_norms(rows, found, max(1, n)), "documents")
    else:
        value = grams.select("gram", idf(F.col("df"), F.lit(max(1, n))).alias("idf"))
        each = rows.select("doc_id", F.explode(F.arrays_zip("gram", "tf")).alias("x")).select("doc_id", "x.gram", "x.tf").join(value.hint("merge"), "gram")
        weight = (1 + F.log("tf")) * F.col("idf")
        norms = each.groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
        store(rows.join(norms.hint("merge"), "doc_id", "left").na.fill(0.0, ["norm"]), "documents")
    store(spark.createDataFrame([(n, signature)], "n_docs long, signature long"), "meta")
    for name in ("rows", "kinds"):
        fs.delete(folder(spark, f"{path}/{name}")[1], True)
    for name in PARTS:
        for before in done[: 1 - KEPT_VERSIONS]:
            fs.delete(folder(spark, f"{path}/{name}/version={before}")[1], True)
    return Refresh("updated" if done else "built", n, n_new, n_changed, n_gone)


class Asked:
    """A block of queries: the grams they hold, in order, with idf, and who holds each with what weight."""

    def __init__(self, table: pa.Table, n_docs: int):
        code = table.column("key").combine_chunks().dictionary_encode()
        query, self.ids = code.indices.to_numpy().astype(np.int64), code.dictionary
        gram, tf = (table.column(c).to_numpy() for c in ("gram", "tf"))
        found = table.column("df").fill_null(0).to_numpy()
        value = np.log((1 + n_docs) / (1 + found)) + 1
        weight = (1 + np.log(tf)) * value
        weight = weight / np.sqrt(np.bincount(query, weight * weight, len(self.ids)))[query]
        # A gram that no document has counts for the norm alone.
        keep = np.flatnonzero(found > 0)
        keep = keep[np.argsort(gram[keep], kind="stable")]
        self.gram, first = np.unique(gram[keep], return_index=True)
        self.first, self.idf = np.append(first, len(keep)), value[keep][first]
        self.query, self.weight = query[keep], weight[keep]

    def scores(self, gram: np.ndarray, tf: np.ndarray, norm: float) -> np.ndarray:
        if not len(gram) or not len(self.gram):
            return np.zeros(len(self.ids))
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        known = self.gram[at] == gram
        at = at[known]
        w = (1 + np.log(tf[known])) * self.idf[at] / norm
        count = self.first[at + 1] - self.first[at]
        held = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.query[held], np.repeat(w, count) * self.weight[held], len(self.ids))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, min_score: float = 0.0, block: int = scoring.SENT_ROWS) -> DataFrame:
    """``query_id, doc_id, score, place`` as ``retrieval.tfidf_topk`` gives them for the indexed documents; ``queries`` has query_id and text.

    Only the queries' grams are looked up and sent to the tasks, at most about ``block`` of them at a time: more queries are searched in blocks. Each
    task scores its stored documents and keeps its best. An index without a version: an error.
    """
    done = versions(spark, path)
    if not done:
        raise ValueError(f"no index in {path}")
    n_docs = max(1, part(spark, path, "meta", done[-1]).first()["n_docs"])
    docs = part(spark, path, "documents", done[-1])
    asked = scoring.coded_counts(queries.select("query_id", padded(F.coalesce("text", F.lit(""))).alias("padded")), "query_id", "padded")
    asked = asked.join(part(spark, path, "grams", done[-1]), "gram", "left").select("key", "gram", "tf", "df")
    blocks = -(-asked.count() // block) or 1
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(Asked(own.toArrow(), n_docs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in scoring.portions(batches):
                lists = [(batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("gram", "tf")]
                norms = batch.column("norm").to_numpy()
                rows = [block.scores(*(v[o[i] : o[i + 1]] for v, o in lists), norms[i]) for i in range(batch.num_rows)]
                scores = np.array(rows).reshape(batch.num_rows, len(block.ids))
                yield scoring.best_of(batch, scores, block.ids, k, min_score, ["doc_id", "rank"], scores > 0)

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, rank {docs.schema['rank'].dataType.simpleString()}, raw double"
        found = docs.select("doc_id", "rank", "gram", "tf", "norm").mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    return scoring.placed(out, "doc_id", k, "rank")
