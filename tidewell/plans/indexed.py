"""Queries over stored indexes and a document store, and their SQL. Each makes its index or store in a folder of its own below the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import stored_index, vector_index
from tidewell.plans import retrieved
from tidewell.sources.store import DocumentStore
from tidewell.sources.tables import samples, shared_base, table


def new_folder(spark: SparkSession) -> str:
    return f"{shared_base(spark)}/tidewell-index-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("rank"))


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they were: a third was missing, some read otherwise, some are gone since."""
    docs = documents(spark, sf_dir)
    before = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("an older wording "), "text")).otherwise(F.col("text")))
    return before.unionByName(docs.where("doc_id % 7 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "text", "rank"))


def updated_index(spark: SparkSession, sf_dir: str) -> tuple[str, list[stored_index.Refresh]]:
    path = new_folder(spark)
    return path, [stored_index.refresh(docs, path) for docs in (earlier(spark, sf_dir), documents(spark, sf_dir), documents(spark, sf_dir))]


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``lexical_topk`` in an index that was built of the earlier documents and then updated."""
    path, _ = updated_index(spark, sf_dir)
    return stored_index.search(spark, path, retrieved.items(spark, sf_dir), k=3)


def index_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each refresh found to do, and the stored counts of grams after it."""
    path, done = updated_index(spark, sf_dir)
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(done)], "step int, action string, n_docs long, n_new long, n_changed long, n_gone long")
    grams = stored_index.part(spark, path, "grams", stored_index.versions(spark, path)[-1]).agg(F.count("*").alias("n_grams"), F.sum("df").alias("sum_df"))
    return rows.crossJoin(F.broadcast(grams))


def verified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over approved and, of rejected samples, corrected ones alone, approved first among equals."""
    rank = F.when(F.col("status") == "approved", 1).otherwise(0)
    usable = samples(spark, sf_dir).where("status = 'approved' or status = 'rejected' and lang = 'en'").select("doc_id", "text", rank.alias("rank"))
    path = new_folder(spark)
    stored_index.refresh(usable, path)
    return stored_index.search(spark, path, retrieved.items(spark, sf_dir), k=2, min_score=0.2)


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``vector_topk``, every twentieth vector against all, in an inverted-file index; approximate."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = new_folder(spark)
    vector_index.build(rows, path, cells=32)
    return vector_index.search(spark, path, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=5, probes=20)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten events of each user in a store that was written twice: first without clicks, then with clicks and new values of every fifth event."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    store = DocumentStore(spark, new_folder(spark), "event_id", "ts", ["user_id"], keep=10)
    store.write(events.where("event_type <> 'click'"))
    later = events.where("event_type = 'click' or event_id % 5 = 0")
    store.write(later.withColumn("value", F.when(F.col("event_id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value"))))
    return store.read().select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (indexed_topk, index_refreshes, verified_topk, ivf_topk, stored_events)}

USABLE = f"""samples AS (SELECT d.*, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
usable AS (SELECT doc_id, text, CASE status WHEN 'approved' THEN 1 ELSE 0 END AS rank FROM samples WHERE status = 'approved' OR status = 'rejected' AND lang = 'en')"""
ORACLE_SQL = {
    "indexed_topk": retrieved.ORACLE_SQL["lexical_topk"],
    "index_refreshes": f"""WITH d AS ({retrieved.grams_sql('doc_id', 'documents')}), g AS (SELECT count(DISTINCT gram) AS n_grams, count(*) AS sum_df FROM d),
n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS new, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS changed, count(*) FILTER (doc_id % 7 = 0) AS gone FROM documents)
SELECT step, action, n_docs, n_new, n_changed, n_gone, n_grams, sum_df FROM g, (SELECT 0 AS step, 'built' AS action, n - new + gone AS n_docs, n - new + gone AS n_new, 0 AS n_changed, 0 AS n_gone FROM n
  UNION ALL SELECT 1, 'updated', n, new, changed, gone FROM n UNION ALL SELECT 2, 'unchanged', n, 0, 0, 0 FROM n)""",
    "verified_topk": f"""WITH {USABLE}, d AS ({retrieved.grams_sql('doc_id', 'usable')}), q AS ({retrieved.grams_sql('item_id', 'benchmark')}),
n AS (SELECT count(*) AS n FROM usable), f AS (SELECT gram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM d, n GROUP BY gram),
w AS (SELECT doc_id, gram, (1 + ln(tf)) * idf AS w FROM d JOIN f USING (gram)), wn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
v AS (SELECT item_id, gram, (1 + ln(tf)) * coalesce(idf, ln(1 + n) + 1) AS v FROM q LEFT JOIN f USING (gram), n), vn AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1),
s AS (SELECT item_id AS query_id, doc_id, sum(w * v) / any_value(wn.norm) / any_value(vn.norm) AS raw FROM w JOIN v USING (gram) JOIN wn USING (doc_id) JOIN vn USING (item_id) GROUP BY 1, 2)
SELECT query_id, doc_id, score, place FROM (SELECT query_id, doc_id, round(raw, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, rank DESC, doc_id) AS place
  FROM s JOIN usable USING (doc_id) WHERE raw >= 0.2) WHERE place <= 2""",
    "stored_events": """SELECT user_id, event_id, event_type, value FROM (
  SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS place FROM events)
WHERE place <= 10""",
}
