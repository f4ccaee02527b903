"""The inverted-file index: recall against the exact search, and exact with all cells probed."""

import random

from tests.test_queries import SF
from tidewell.operators import retrieval, vector_index
from tidewell.plans import indexed, retrieved


def test_recall(spark):
    exact = {(r["query_id"], r["vec_id"]) for r in retrieved.vector_topk(spark, SF).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in indexed.ivf_topk(spark, SF).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_all_cells_are_exact(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 7, 2) for _ in range(6)]) for i in range(300)] + [(300, [0.0] * 6), (301, None), (302, [1.0] * 6), (303, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = f"file://{tmp_path}/index"
    vector_index.build(df, path, cells=9, sample=50)
    queries = df.where("vec_id % 20 = 0 or vec_id > 300").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk(df.where("embedding is not null"), queries.where("embedding is not null"), 4).collect()))
    for block in (1000, 5):
        assert sorted(map(tuple, vector_index.search(spark, path, queries, 4, probes=9, block=block).collect())) == want
    assert vector_index.search(spark, path, queries.where("false"), 4).count() == 0
