"""Queries of the curation family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import mojibake, normal, sha1_remainder, sha1_remainder_sql, split_name
from tidewell.operators import curation, latest
from tidewell.sources.tables import SAMPLES_SQL, samples, table

NORMAL_SQL = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
DOC = "CAST(doc_id AS VARCHAR)"
R_SQL = sha1_remainder_sql(DOC)
#: Ranks of sources; later rows win ties.
PRIORITY = {"src0": 3, "src1": 2, "src2": 2, "src3": 1}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def remainder():
    return sha1_remainder(F.col("doc_id").cast("string"))


def priority_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = latest.ranked_by("source", PRIORITY)
    rows = docs(spark, sf_dir).select("doc_id", "source", F.sha1(normal(F.col("text"))).alias("key"))
    return latest.priority_dedupe(rows, F.col("key"), rank, "doc_id").select("doc_id", "source")


def verified_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level priority: approved before the rest, then the source."""
    rank = latest.ranked_by("status", {"approved": 10}) + latest.ranked_by("source", PRIORITY)
    rows = samples(spark, sf_dir).where("status <> 'rejected'").select("doc_id", "source", "status", F.sha1(normal(F.col("text"))).alias("key"))
    return latest.priority_dedupe(rows, F.col("key"), rank, "doc_id").select("doc_id", "source", "status")


def mojibake_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", (~mojibake(F.col("text"))).alias("usable"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", split_name(F.col("doc_id").cast("string")).alias("split"))


def eval_leak_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "text")
    held = rows.where(remainder() == 0)
    return curation.without_leaks(rows.where(remainder() != 0), held, normal(F.col("text"))).select("doc_id")


def eval_leak_nospace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "text")
    key = curation.spaceless(F.col("text"))
    kept = curation.without_leaks(rows.where(remainder() != 0), rows.where(remainder() == 0), key)
    return curation.without_self_repeats(kept.withColumn("text", F.sha1(key)), F.col("text"), "doc_id").select("doc_id")


def eval_leak_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.containment(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def request_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("r", remainder())
    jobs = rows.where("r >= 2").select(F.col("doc_id").alias("job_id"), F.col("text").alias("prompt"))
    known = rows.where("r < 4").select(F.when(F.col("r") >= 2, F.col("doc_id")).alias("origin_id"), F.lit(None).cast("long").alias("job_id"), F.when(F.col("r") < 2, F.col("text")).alias("prompt"))
    return curation.request_candidates(jobs, known).select("job_id")


def feedback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("origin_id"),
        F.when(F.col("event_type").isin("click", "purchase"), "LIKE").when(F.col("event_type") == "error", "dislike").alias("vote"),
        F.when(F.col("event_type") == "signup", "pipeline_failure").otherwise("user").alias("source"),
        (F.col("value") > 10).alias("has_answer"), (F.col("value") > 5).alias("has_parsed"),
        F.col("props").alias("prompt"), F.when(F.col("value") > 20, F.lit("x.png")).alias("image_path"),
    )
    return curation.feedback_labels(rows)


def training_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("doc_id", "text", "status").withColumn("r", remainder())
    held, rest = rows.where("r = 0").select("doc_id", "text"), rows.where("r > 0")
    parts = [rest.where(x).select("doc_id", "text") for x in ("status = 'approved'", "status = 'rejected'", "status = 'pending'")]
    return curation.training_mix(*parts, held, 100).select("doc_id", "stream", "copy")


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    rows = d.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("stratum")).unionByName(d.where(F.col("source") == "src0").select(F.col("doc_id").alias("item_id"), F.lit("src0").alias("stratum")))
    return curation.quota_sample(rows, {"en": 60, "de": 40, "fr": 40, "es": 40, "src0": 10}, 150)


def retrain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).where("status = 'approved'").select("doc_id")
    return curation.retrain_gate(rows, rows.where(remainder() < 5), "doc_id", 200)


def augment_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("r", remainder())
    made = rows.where("r >= 4").select(F.col("doc_id").alias("seq"), "text", F.col("lang").alias("wanted"), F.when(F.col("r") < 9, F.col("lang")).alias("parsed"))
    return curation.accepted_augmentation(made, rows.where("r < 3").select("text"), rows.where("r = 3").select("text")).select("seq")


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.seeded_split(docs(spark, sf_dir).select("doc_id"), "doc_id", 0.15, 7)


def label_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("image_id"))
    points = F.array_repeat(F.when(F.col("l_discount") > 0.09, 1.5).otherwise(F.col("l_discount")), F.when(F.col("l_quantity") < 3, 4).otherwise(6))
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("cls"), points.alias("points"))
    return curation.label_issues(images, labels, 6)


def class_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(1, 10), (2, 10), (3, 12)], "cls int, new_cls int")
    labels = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("cls"))
    return curation.remapped(labels, mapping).groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("images"))


def instruction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cases = e.select(
        F.col("event_id").alias("case_id"), F.when(F.col("event_type") == "signup", "pipeline_failure").otherwise("user").alias("source"),
        F.when(F.col("event_type") == "error", "dislike").when(F.col("event_type") == "click", "like").alias("vote"),
        F.col("props").alias("prompt"), F.col("event_type").alias("answer"), F.when(F.col("value") > 10, F.lit("fixed")).alias("corrected"),
    )
    return curation.instruction_records(cases, "Q: {prompt} A: {response}")


QUERIES = {f.__name__: f for f in (
    priority_dedupe, verified_dedupe, mojibake_filter, hash_split, eval_leak_exact, eval_leak_nospace, eval_leak_containment, request_candidates, feedback_labels,
    training_mix, quota_sample, retrain_gate, augment_acceptance, seeded_split, label_issues, class_remap, instruction_records,
)}

RANK_SQL = "CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 WHEN 'src3' THEN 1 ELSE 0 END"
DOCS_SQL = f"d AS (SELECT *, {R_SQL} AS r, {NORMAL_SQL.format('text')} AS key FROM documents)"
ORACLE_SQL = {
    "priority_dedupe": f"""WITH {DOCS_SQL} SELECT doc_id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY {RANK_SQL} DESC, doc_id DESC) AS place FROM d) WHERE place = 1""",
    "verified_dedupe": f"""WITH {SAMPLES_SQL} SELECT doc_id, source, status FROM (
  SELECT *, row_number() OVER (PARTITION BY {NORMAL_SQL.format('text')} ORDER BY CASE status WHEN 'approved' THEN 10 ELSE 0 END + {RANK_SQL} DESC, doc_id DESC) AS place
  FROM samples WHERE status <> 'rejected') WHERE place = 1""",
    "mojibake_filter": "SELECT doc_id, NOT (text IS NULL OR trim(text) = '' OR (regexp_matches(text, '[\\x{80}-\\x{ff}]') AND NOT regexp_matches(text, '[가-힣]'))) AS usable FROM documents",
    "hash_split": f"SELECT doc_id, CASE WHEN {R_SQL} = 0 THEN 'val' ELSE 'train' END AS split FROM documents",
    "eval_leak_exact": f"WITH {DOCS_SQL} SELECT doc_id FROM d WHERE r <> 0 AND key NOT IN (SELECT key FROM d WHERE r = 0)",
    "eval_leak_nospace": f"""WITH d AS (SELECT doc_id, {R_SQL} AS r, replace(lower(text), ' ', '') AS key FROM documents)
SELECT min(doc_id) AS doc_id FROM d WHERE r <> 0 AND key NOT IN (SELECT key FROM d WHERE r = 0) GROUP BY key""",
    "eval_leak_containment": f"""SELECT d.doc_id, b.item_id FROM (SELECT doc_id, ' ' || {NORMAL_SQL.format('text')} || ' ' AS form FROM documents) d
JOIN (SELECT item_id, ' ' || {NORMAL_SQL.format('text')} || ' ' AS item FROM benchmark) b ON contains(form, item)""",
    "request_candidates": f"""WITH {DOCS_SQL} SELECT min(doc_id) AS job_id FROM d
WHERE r >= 4 AND NOT (regexp_matches(text, '[\\x{{80}}-\\x{{ff}}]') AND NOT regexp_matches(text, '[가-힣]')) AND trim(text) <> ''
  AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') NOT IN (SELECT text FROM d WHERE r < 2)
GROUP BY regexp_replace(text, '^\\s+|\\s+$', '', 'g')""",
    "feedback_labels": """SELECT event_id AS origin_id, 'prompt' AS kind, CASE event_type WHEN 'error' THEN 'correction' ELSE 'like' END AS source FROM events
WHERE (event_type IN ('click', 'purchase') AND value > 5) OR (event_type = 'error' AND value > 10)
UNION ALL SELECT event_id, 'segment', 'pipeline_failure' FROM events WHERE event_type = 'signup' AND value > 20""",
    "training_mix": f"""WITH {SAMPLES_SQL}, d AS (SELECT *, {R_SQL} AS r, {NORMAL_SQL.format('text')} AS key FROM samples),
mixed AS (
  SELECT doc_id, key, 'approved' AS stream, c AS copy FROM d, generate_series(1, 3) t(c) WHERE r > 0 AND status = 'approved'
  UNION ALL SELECT doc_id, key, 'seed', c FROM d, generate_series(1, 2) t(c) WHERE r > 0 AND status = 'rejected'
  UNION ALL SELECT * FROM (SELECT doc_id, key, 'pseudo', 1 FROM d WHERE r > 0 AND status = 'pending' ORDER BY sha1('0:' || doc_id), doc_id LIMIT 100))
SELECT doc_id, stream, CAST(copy AS INT) AS copy FROM mixed WHERE key NOT IN (SELECT key FROM d WHERE r = 0)""",
    "retrain_gate": f"""WITH {SAMPLES_SQL} SELECT count(*) AS n_new, count(*) >= 200 AS retrain FROM samples WHERE status = 'approved' AND {R_SQL} >= 5""",
    "augment_acceptance": f"""WITH {DOCS_SQL} SELECT min(doc_id) AS seq FROM d WHERE r BETWEEN 4 AND 8 AND key NOT IN (SELECT key FROM d WHERE r < 4) GROUP BY key""",
    "seeded_split": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha1('7:' || doc_id), doc_id) <= greatest(round(count(*) OVER () * 0.15), 1) THEN 'val' ELSE 'train' END AS split FROM documents""",
    "label_issues": """WITH i AS (SELECT o_orderkey AS image_id FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT l_orderkey AS image_id, bool_or(l_linenumber > 6) AS bad_class, bool_or(l_quantity < 3) AS short_polygon, bool_or(l_discount > 0.09) AS out_of_range FROM lineitem GROUP BY 1)
SELECT image_id, 'no_label' AS issue FROM i WHERE image_id NOT IN (SELECT image_id FROM l)
UNION ALL SELECT image_id, 'no_image' FROM l WHERE image_id NOT IN (SELECT image_id FROM i)
UNION ALL SELECT image_id, 'bad_class' FROM l WHERE bad_class UNION ALL SELECT image_id, 'short_polygon' FROM l WHERE short_polygon
UNION ALL SELECT image_id, 'out_of_range' FROM l WHERE out_of_range""",
    "class_remap": """SELECT CASE WHEN l_linenumber < 3 THEN 10 ELSE 12 END AS cls, count(*) AS n, count(DISTINCT l_orderkey) AS images FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1""",
    "instruction_records": """SELECT event_id AS case_id, 'Q: ' || trim(props) || ' A: ' || CASE event_type WHEN 'error' THEN 'fixed' ELSE event_type END AS line FROM events
WHERE event_type <> 'signup' AND (event_type <> 'error' OR value > 10)""",
}
