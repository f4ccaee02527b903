"""The stored index: updates equal builds, broken refreshes don't count, blocks of queries."""

import random

import pytest

from tidewell.operators import retrieval, stored_index

DOCS = "doc_id long, text string, rank int"


def made(n, seed):
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choice("abcd é") for _ in range(6)) for _ in range(r.randrange(0, 9))), i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, t) for i, t, _ in made(12, 99)] + [(50, None), (51, "zzz")], "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_update_equals_build(spark, tmp_path, queries):
    first = made(60, 1) + [(70, None, 0), (71, "", 0), (None, "no id", 0)]
    then = [(i, t + (" new" if i % 4 == 0 else ""), 9 if i == 7 else r) for i, t, r in first if i is not None and i % 5] + [(100 + i, t, r) for i, t, r in made(20, 2)]
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    first, then = spark.createDataFrame(first, DOCS), spark.createDataFrame(then, DOCS)
    assert stored_index.refresh(first, one).action == "built"
    assert rows(stored_index.search(spark, one, queries)) == rows(retrieval.tfidf_topk(first.where("doc_id is not null").na.fill(""), queries.na.fill(""), priority=first["rank"]))
    n = then.count()
    changed = then.join(first.withColumnRenamed("text", "old").withColumnRenamed("rank", "before"), "doc_id").where("coalesce(text, '') <> coalesce(old, '') or rank <> before").count()
    assert stored_index.refresh(then, one) == stored_index.Refresh("updated", n, 20, changed, 13)
    assert stored_index.refresh(then.repartition(3), one) == stored_index.Refresh("unchanged", n, 0, 0, 0)
    stored_index.refresh(then, two)
    for name in ("grams", "documents"):
        a, b = (stored_index.part(spark, p, name, stored_index.versions(spark, p)[-1]) for p in (one, two))
        if name == "documents":
            a, b = (x.selectExpr("doc_id", "rank", "mark", "gram", "tf", "round(norm, 9)") for x in (a, b))
        assert rows(a) == rows(b)
    assert rows(stored_index.search(spark, one, queries)) == rows(stored_index.search(spark, two, queries))
    # Queries in blocks give the same.
    assert rows(stored_index.search(spark, one, queries, 2, 0.1, block=40)) == rows(stored_index.search(spark, one, queries, 2, 0.1))


def test_broken_refresh_does_not_count(spark, tmp_path, queries):
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        stored_index.search(spark, path, queries)
    docs = spark.createDataFrame(made(30, 3), DOCS)
    stored_index.refresh(docs, path)
    before = rows(stored_index.search(spark, path, queries))
    # A writer that died: documents of the next version are there, its meta isn't whole.
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{path}/documents/version=1")
    (tmp_path / "index/meta/version=1").mkdir()
    assert stored_index.versions(spark, path) == [0] and rows(stored_index.search(spark, path, queries)) == before
    assert stored_index.refresh(docs.where("doc_id < 20"), path).n_gone == 10
    assert stored_index.versions(spark, path) == [0, 1]
    stored_index.refresh(docs, path)
    assert stored_index.versions(spark, path) == [1, 2] and rows(stored_index.search(spark, path, queries)) == before


def test_empty(spark, tmp_path, queries):
    path = f"file://{tmp_path}/index"
    none = spark.createDataFrame([], DOCS)
    assert stored_index.refresh(none, path) == stored_index.Refresh("built", 0, 0, 0, 0)
    assert stored_index.search(spark, path, queries).count() == 0
    assert stored_index.refresh(none, path).action == "unchanged"
    stored_index.refresh(spark.createDataFrame(made(5, 4), DOCS), path)
    assert stored_index.search(spark, path, queries.where("false")).count() == 0
    assert stored_index.refresh(none, path).n_gone == 5
