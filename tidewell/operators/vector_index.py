"""A stored inverted-file index of vectors: cells around trained centroids, searched by probing the nearest and comparing exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import scoring

#: Vectors that the centroids are trained on, about, and rounds of training.
SAMPLE, ROUNDS = 20_000, 12
#: Queries sent to the tasks at a time.
BLOCK = 100_000


def trained(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; each next start is the vector farthest from those so far."""
    if not len(sample):
        return np.zeros((0, 1))
    centre = [sample.mean(axis=0)]
    near = sample @ centre[0]
    for _ in range(min(cells, len(sample))):
        centre.append(sample[int(near.argmin())])
        near = np.maximum(near, sample @ centre[-1])
    out = np.array(centre[1:])
    for _ in range(rounds):
        own = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.maximum(size, 1e-12), out)
    return out


def build(vectors: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE) -> None:
    """Store ``vectors`` (vec_id, embedding) in folders by cell below ``path``.

    Centroids are trained on about ``sample`` rows, drawn by a hash of vec_id, so their number of bytes has a fixed bound; every row is stored. Null
    embeddings are left out; all others have one length. A cell of any size is many files, read by many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = rows.count()
    drawn = rows if total <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < sample)
    centre = trained(scoring.vectors(drawn.orderBy("vec_id").select("embedding").toArrow().column(0).combine_chunks()), cells)
    shared = spark.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scoring.portions(batches, 4096):
            own = (scoring.vectors(batch.column("embedding")) @ shared.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["vec_id", "embedding", "cell"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = rows.mapInArrow(run, f"vec_id {kind}, embedding array<double>, cell int")
    placed.write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], "cell int, centre array<double>").write.parquet(f"{path}/centres")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = 8, min_score: float = -1.0, block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, score, place``: the nearest of the vectors in the ``probes`` cells nearest to each query (query_id, embedding), by exact cosine.

    Only folders of probed cells are read. A task compares its rows with those queries of a block that probe their cell and keeps its best; queries
    beyond ``block`` go in blocks. With as many probes as cells the result is exact. A vector doesn't meet the query of its own id.
    """
    stored = spark.read.parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    centre = np.array([r["centre"] for r in rows]).reshape(len(rows), -1)
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = -(-asked.count() // block) or 1
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        sent = own.toArrow().combine_chunks()
        ids = sent.column("query_id").combine_chunks() if sent.num_rows else pa.array([], sent.schema.field("query_id").type)
        q = scoring.vectors(sent.column("embedding").combine_chunks()) if sent.num_rows else np.zeros((0, centre.shape[1]))
        near = np.argsort(-(q @ centre.T), axis=1, kind="stable")[:, :probes]
        probed = np.zeros((len(q), len(centre)), bool)
        np.put_along_axis(probed, near, True, axis=1)
        shared = spark.sparkContext.broadcast((ids, q, probed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, probed = shared.value
            for batch in scoring.portions(batches):
                cells = batch.column("cell").to_numpy()
                for cell in np.unique(cells):
                    some = np.flatnonzero(probed[:, cell])
                    if len(some):
                        part, own = batch.take(pa.array(np.flatnonzero(cells == cell))), ids.take(pa.array(some))
                        other = np.array(part.column("vec_id").to_pylist(), object)[:, None] != np.array(own.to_pylist(), object)[None, :]
                        yield scoring.best_of(part, scoring.vectors(part.column("embedding")) @ q[some].T, own, k, min_score, ["vec_id"], other)

        read = stored.where(F.col("cell").isin(np.flatnonzero(probed.any(axis=0)).tolist())).select("vec_id", "embedding", F.col("cell").cast("int").alias("cell"))
        found = read.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {stored.schema['vec_id'].dataType.simpleString()}, raw double")
        out = found if out is None else out.unionByName(found)
    return scoring.placed(out, "vec_id", k)
