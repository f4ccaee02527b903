"""What keeps queries' work in proportion to their input: the steps of their plans, and exactness of the forms that replaced joins."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tidewell.functions.text import compact
from tests.test_queries import SF
from tidewell.operators import answers, curation, parts, retrieval, scoring, state, stored_index, vision
from tidewell.plans import retrieved, shapes, worded


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id")


TEXTS = ["keep the red dog", "a dog, a cat", "", "red red dog", None, "배경 강아지 dog", "x", "the cat-dog"]


def test_document_blend_makes_no_pairs(spark):
    """chunks meet the queries within their task; no row per shared gram."""
    docs, queries = some(spark, TEXTS)
    chunks = docs.selectExpr("cast(doc_id as string) as chunk_id", "substring(text, 1, 6) as title", "text", "1.0 as weight")
    found = plan(retrieval.document_blend(chunks, queries))
    assert "Join" not in found and "Generate" not in found


def test_gram_df_in_tasks(spark):
    """a task counts documents by gram before anything is shuffled; no row per document and gram."""
    docs, _ = some(spark, [*TEXTS, "𝒳𝒴 é", "  "])
    found = retrieved.text_df(docs)
    assert "Generate" not in plan(found)
    want = retrieval.gram_df(retrieval.gram_counts(docs, "doc_id"), "doc_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_memory_blend_makes_no_pairs(spark):
    """documents meet the queries within their task; no row per shared gram."""
    found = plan(retrieval.memory_blend(*some(spark, TEXTS)))
    assert "Join" not in found and "Generate" not in found


def test_bm25_keeps_few_of_many_ties(spark):
    """a task gives its best rows, not a row per document and query that share a token; of equal scores the k first by key."""
    docs = spark.range(3000).selectExpr("3000 - id as doc_id", "'red dog' as text").coalesce(1)
    queries = spark.createDataFrame([(1, "dog"), (2, "cat")], "query_id long, text string")
    best = retrieval.bm25_topk(docs, queries, 3)
    assert "Join" not in plan(best) and [tuple(r)[:2] for r in best.orderBy("place").collect()] == [(1, 1), (1, 2), (1, 3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 4, 3, 2]})
    assert scoring.best_of(batch, np.ones((4, 1)), pa.array([7]), 2, 0.0, ["doc_id"]).column("doc_id").to_pylist() == [2, 3]


def test_hashed_cells_in_tasks(spark):
    """cells are cut from texts within tasks, as zlib hashes them; the plan makes no arrays of characters."""
    docs, queries = some(spark, [*TEXTS, "é漢", "𝒳a"])
    found = plan(retrieval.hash_topk(docs, queries))
    assert "split(" not in found and "transform(" not in found
    texts = [r[0] for r in docs.select(compact("text")).collect()]
    got = scoring.cell_vectors(64)(pa.array(texts))
    for vector, text in zip(got, texts, strict=True):
        t = text or ""
        grams = [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)] if len(t) > 1 else [t or "empty"]
        cells = np.log1p(np.bincount([crc32(g.encode()) % 64 for g in grams], minlength=64))
        assert np.allclose(vector, cells / np.linalg.norm(cells))


def test_images_over_batches(spark):
    """images stream, so one that is cut by a batch's end is still judged whole; no call per image."""
    rows = [(i % 9, i, "ab"[i % 2], i * 7 % 11 / 11, float(i % 13), float(i % 7), float(i % 13 + 9), float(i % 7 + 8)) for i in range(200)]
    df = spark.createDataFrame(rows, "image int, k int, label string, conf double, x0 double, y0 double, x1 double, y1 double")
    found = parts.suppressed(df, "image", "label", "conf", "k", 0.3, 15, 5)
    assert "FlatMapGroups" not in plan(found)
    want = sorted(map(tuple, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, parts.suppressed(df, "image", "label", "conf", "k", 0.3, 15, 5).collect())) == want and len(want) > 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_answers_read_once(spark):
    """the JSON is read by one expression; a count of lines doesn't work the answer out a second time for its filter."""
    df = spark.createDataFrame([(1, 'x {"target": ["a dog"]}'), (2, 'y {"target": ["a dog"]}'), (3, "none")], "k long, text string").repartition(1)
    rows = answers.parsed(df, F.col("text"), {"dog": "dog"}, {})
    assert "get_json_object" not in plan(rows)
    lines = answers.answer_lines(rows)
    assert plan(lines).count("regexp_extract(") == 1 and [r["n"] for r in lines.collect()] == [2]


def test_poisson_weights():
    """weights of many rows are made at a time, Poisson of mean 1, the same for a row wherever it lies."""
    seeds = np.random.default_rng(3).integers(0, 2**63, 4000).astype(np.uint64)
    w = vision.poisson_weights(seeds, 101)
    assert w.shape == (4000, 101) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (vision.poisson_weights(seeds[7:9], 101) == w[7:9]).all() and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_tracks_are_shuffled_once(spark):
    """a clip's rows are dealt once, without their looks' arrays; before, frames and rows were joined and gathered in shuffles of their own."""
    found = plan(shapes.tracked(spark, SF)).split("Initial Plan")[-1]
    assert found.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in found and "ENSURE_REQUIREMENTS" not in found.split("REPARTITION_BY_NUM")[0]


def test_folds_keep_their_tasks(spark):
    """stores are dealt over a fixed number of tasks, since little data with much work would otherwise run in one."""
    df = spark.range(64).selectExpr("id % 16 as k", "id as t")
    rows = state.folded(df, "k", ["t"], ["t"], lambda now, values: (None, (1.0,)), "x double")
    assert "REPARTITION_BY_NUM" in plan(rows)


def test_norms_in_tasks(spark, tmp_path, monkeypatch):
    """norms are worked out where a document's grams lie; both ways give the same."""
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, rank int")
    norms = []
    for name, most in (("one", scoring.SENT_ROWS), ("two", 3)):
        monkeypatch.setattr(scoring, "SENT_ROWS", most)
        path = f"file://{tmp_path}/{name}"
        stored_index.refresh(docs, path)
        norms.append({r["doc_id"]: r["norm"] for r in stored_index.part(spark, path, "documents", 0).collect()})
    assert norms[0].keys() == norms[1].keys() and np.allclose(*([n[k] for k in sorted(n)] for n in norms))
    rows, grams = (stored_index.part(spark, f"file://{tmp_path}/one", name, 0) for name in ("documents", "grams"))
    assert "Exchange" not in plan(stored_index.with_norms(rows.drop("norm"), grams.toArrow(), len(TEXTS)))


def test_merged_searches_run_once(spark):
    """each of the merged searches stands once in the plan; the first stood there twice and was scored twice."""
    found = plan(retrieved.hybrid_merge(spark, SF)).split("Initial Plan")[-1]
    assert found.count("MapInArrow") == 2 and "Join" not in found


def test_classes_are_not_gathered(spark):
    """F16: a mapping of classes goes to the labels, so no task sorts all rows of a class."""
    labels = spark.range(100).selectExpr("id", "cast(id % 3 as int) as cls")
    found = plan(curation.remapped(labels, spark.createDataFrame([(1, 10), (2, 10)], "cls int, new_cls int")))
    assert "BroadcastHashJoin" in found and "hashpartitioning" not in found


def test_prompts_are_read_in_their_row(spark):
    """a prompt's mentions stay in its row; they were dealt by key twice, and their result was joined back."""
    for query in (worded.worded_effects, worded.worded_targets):
        found = plan(query(spark, SF))
        assert "Exchange" not in found and "Join" not in found and "Window" not in found


def test_links_in_portions(spark):
    """links are joined within tasks, a group that one can't hold at once by rounds; both ways give the same."""
    r = random.Random(5)
    pairs = [(g, r.randrange(n), r.randrange(n)) for g, n in (("a", 9), ("b", 60), ("c", 300)) for _ in range(n)] + [("d", i + 1, i) for i in range(40)]
    edges = spark.createDataFrame(pairs, "g string, a long, b long").where("a <> b")
    one, many = (sorted(tuple(x) for x in parts.least_linked(edges, ["g"], most).select("g", "a", "least").collect() if x["a"] != x["least"]) for most in (10**6, 7))
    assert one == many and [x for x in one if x[0] == "d"] == [("d", i, 0) for i in range(1, 41)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(tuple(x) for x in parts.least_linked(edges, ["g"], 7).select("g", "a", "least").collect() if x["a"] != x["least"]) == one
        assert parts.near_linked(edges, ["g"]).where("not ended").count() == 0 and parts.near_linked(edges, ["g"], 7).where("not ended").count() > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_masks_of_all_modes_at_once(spark):
    """cells are dealt once by group for all modes, not for each."""
    rows = shapes.masks(spark, SF)
    target, others = rows.where("inst = 'N' and l_quantity > 15"), rows.where("inst <> 'N' and l_quantity > 25")
    modes = ("off", "subtract", "conf", "front")
    kept = lambda m: sorted(tuple(x) for x in parts.exclusive_mask(target, others, "image", "inst", m, 8).collect())
    got = parts.exclusive_masks(target, others, "image", "inst", modes, 8)
    assert plan(got).count("FileScan") == 0
    got = got.collect()
    for m in modes:
        assert sorted((x["image"], x["x"], x["y"]) for x in got if x["mode"] == m) == kept(m)
