"""Retrieval operators without SQL, against plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import retrieval
from tidewell.sources import text_files

def test_hash_topk(spark):
    """Texts alike without blanks and case have score 1, texts without a common gram no hit; an empty or null text meets empty ones."""
    docs = spark.createDataFrame([(1, "Keep the RED dog"), (2, "keepthered dog"), (3, "zzzz"), (4, ""), (5, "x"), (6, "keep the red dogs and a cat"), (7, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "keep the red dog"), (2, ""), (3, "x"), (4, "配")], "query_id long, text string")
    got = [tuple(r) for r in retrieval.hash_topk(docs, queries, 3, 0.3).orderBy("query_id", "place").collect()]
    assert [r[:3] for r in got if r[0] == 1] == [(1, 1, 1.0), (1, 2, 1.0), (1, 6, got[2][2])] and 0.6 < got[2][2] < 1
    assert [r[:3] for r in got if r[0] > 1] == [(2, 4, 1.0), (2, 7, 1.0), (3, 5, 1.0)]


def test_one_more(spark):
    kind = "query_id long, doc_id long, score double, place int"
    first = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.8, 2)], kind)
    second = spark.createDataFrame([(1, 8, 0.99, 1), (1, 9, 0.7, 2), (1, 10, 0.6, 3), (2, 5, 0.5, 1)], kind)
    got = sorted((r["query_id"], r["place"], r["doc_id"]) for r in retrieval.with_one_more(first, second).collect())
    assert got == [(1, 1, 7), (1, 2, 8), (1, 3, 9), (2, 1, 5)]


def test_chunks_by_hand(spark):
    body = "0123456789" * 100
    docs = spark.createDataFrame([(1, f"# First\n{body}\n## Second\nshort"), (2, "## A heading that is long enough\nline"), (3, "tiny"), (4, None), (5, f"Long\n{body}{body[:200]}")], "doc_id long, text string")
    got = {(r["doc_id"], r["section"], r["part"]): (r["title"], r["text"]) for r in text_files.chunks(docs).collect()}
    assert got.keys() == {(1, 0, 0), (2, 0, 0), (5, 0, 0), (5, 0, 1)}
    assert got[1, 0, 0] == ("First", f"# First\n{body}") and got[2, 0, 0] == ("A heading that is long enough", "## A heading that is long enough\nline")
    assert got[5, 0, 0] == ("Long", f"Long\nLong\n{body[:895]}") and got[5, 0, 1][1] == f"Long\n{(body + body)[715:1200]}"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1101, 4000))
def test_windows_cover_the_text(spark, n):
    """Windows of 900 characters, of which the next repeats the last 180, put together are the text."""
    text = "".join(chr(97 + k * k % 26) for k in range(n))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = [r["w"] for r in rows.select(F.posexplode(text_files.windows(F.col("text"))).alias("k", "w")).orderBy("k").collect()]
    assert all(len(p) <= 900 for p in parts) and parts[0] + "".join(p[180:] for p in parts[1:]) == text


def test_context(spark):
    rows = [(1, f"c{i}", s, x, n) for i, (s, x, n) in enumerate([("a", 1.0, 10), ("a", 0.9, 10), ("a", 0.8, 10), ("b", 0.7, 10), ("c", 0.3, 10), ("d", 0.2, 10)])]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id string, source string, score double, length int")
    got = [r["chunk_id"] for r in retrieval.context(hits).orderBy("place").collect()]
    assert got == ["c0", "c1", "c3"]  # the fourth, of source c, is below 0.45 of the best, which ends the list
    assert [r["chunk_id"] for r in retrieval.context(hits, floor=0.0, most=6, most_chars=25).orderBy("place").collect()] == ["c0", "c1", "c3"]
    assert retrieval.context(hits.where("false")).count() == 0
