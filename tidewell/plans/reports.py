"""Queries of the reporting family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import split_name, sha1_remainder_sql
from tidewell.operators import latest, reporting
from tidewell.sources.tables import SAMPLES_SQL, samples, table

#: The sources that the group name ``user`` stands for.
USER_SOURCES = {"user": ("src0", "src1", "src2")}
#: "Now" of time-dependent reports.
NOW = "2024-03-01 00:00:00"
SPLIT_SQL = f"CASE WHEN {sha1_remainder_sql('CAST(doc_id AS VARCHAR)')} = 0 THEN 'val' ELSE 'train' END"


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.counted(samples(spark, sf_dir), "status")


def source_status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.counted(samples(spark, sf_dir), "source", "status")


def approved_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).where("status = 'approved'")
    return reporting.counted(rows.withColumn("split", split_name(F.col("doc_id").cast("string"))), "split")


def approved_user_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = reporting.source_filter("user", USER_SOURCES)
    return samples(spark, sf_dir).agg(F.count_if((F.col("status") == "approved") & wanted).alias("n"))


def sample_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).where(reporting.source_filter("src0, src3,src5", USER_SOURCES))
    rows = reporting.matching(rows, hidden="rejected", contains="THE", lang="en")
    return reporting.page(rows.select("doc_id", "source", "status"), [F.asc("doc_id")], limit=500, offset=2)


def user_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("c_name")
    users = table(spark, sf_dir, "customer").where(name.like("%00%") | F.lower("c_mktsegment").like("%auto%"))
    users = users.select("c_custkey", "c_name", (F.col("c_acctbal") < 0).alias("locked"), F.col("c_mktsegment").isin("BUILDING").alias("is_admin"))
    events = table(spark, sf_dir, "events")
    counts = {"n_orders": (table(spark, sf_dir, "orders"), "o_custkey"), "n_events": (events, "user_id"), "n_errors": (events.where("event_type = 'error'"), "user_id")}
    return reporting.with_counts(users, "c_custkey", **counts)


def event_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.contains(F.lower("props"), F.lit('"k"')))
    rows = rows.withColumn("kind", F.when(F.col("value") > 50, "video")).withColumnRenamed("event_type", "status")
    return reporting.facets(rows, "kind", "status", "image")


def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reporting.dashboard(table(spark, sf_dir, "events"), "event_type", "value", ("click", "error", "purchase"))
    return out.withColumn("mean_quality", F.round("mean_quality", 4))


def nested_failed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "failed")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", status.alias("status"))).alias("items"))
    return items.select("l_orderkey", F.size("items").alias("total"), reporting.failed_items(F.col("items")).alias("failed"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_shipdate").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("completed"), F.sum(F.coalesce("l_quantity", F.lit(0.0))).cast("long").alias("quantity")
    ).select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "total", "completed", "quantity")


def newest_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return reporting.newest(rows, "o_orderdate", "o_orderkey", 3, "o_custkey").select("o_custkey", "o_orderkey", "place")


def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return reporting.newest(rows, "o_orderdate", "o_orderkey", 100).select("o_orderkey")


def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return reporting.usage(rows, "event_type", F.length("props").cast("long"), F.col("ts"), F.lit(NOW).cast("timestamp_ntz"), 30)


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.signature(table(spark, sf_dir, "events"), "ts")


def nested_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.nested_counts(samples(spark, sf_dir), "source", "status")
    return rows.select("source", *(F.coalesce(F.try_element_at("counts", F.lit(x)), F.lit(0)).alias(x) for x in ("approved", "pending", "rejected")))


def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.unix_timestamp(F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")) - F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(reporting.age_name(first).alias("age")).groupBy("age").agg(F.count("*").alias("n"))


def latest_per_user_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return latest.best_per_key(rows, ["user_id", "event_type"], [F.desc("event_id")])


def latest_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("used", F.when(F.col("value") > 30, F.col("ts")))
    rows = rows.where(F.col("used").isNull()).select("user_id", "event_type", "event_id")
    return latest.best_per_key(rows, ["user_id", "event_type"], [F.desc("event_id")])


def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = latest.ranked_by("event_type", {"purchase": 2, "click": 1})
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return latest.best_per_key(rows, ["user_id"], [rank.desc(), F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


def retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return latest.last_rows(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (
    status_counts, source_status_matrix, approved_by_split, approved_user_count, sample_page, user_page_counts, event_facets, dashboard_summary, nested_failed_items,
    batch_totals, newest_per_owner, newest_jobs, storage_usage, signature, nested_source_counts, age_labels, latest_per_user_purpose, latest_unused, best_attempt, retained_history,
)}

ORACLE_SQL = {
    "status_counts": f"WITH {SAMPLES_SQL} SELECT status, count(*) AS n FROM samples GROUP BY status",
    "source_status_matrix": f"WITH {SAMPLES_SQL} SELECT source, status, count(*) AS n FROM samples GROUP BY source, status",
    "approved_by_split": f"WITH {SAMPLES_SQL} SELECT {SPLIT_SQL} AS split, count(*) AS n FROM samples WHERE status = 'approved' GROUP BY 1",
    "approved_user_count": f"WITH {SAMPLES_SQL} SELECT count(*) FILTER (WHERE status = 'approved' AND source IN ('src0', 'src1', 'src2')) AS n FROM samples",
    "sample_page": f"""WITH {SAMPLES_SQL}, hits AS (
  SELECT doc_id, source, status FROM samples
  WHERE source IN ('src0', 'src3', 'src5') AND lang = 'en' AND status <> 'rejected' AND contains(lower(text), 'the'))
SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY doc_id LIMIT 200 OFFSET 2""",
    "user_page_counts": """SELECT c_custkey, c_name, c_acctbal < 0 AS locked, c_mktsegment IN ('BUILDING') AS is_admin,
  coalesce(o.n, 0) AS n_orders, coalesce(e.n, 0) AS n_events, coalesce(e.bad, 0) AS n_errors
FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1) e ON user_id = c_custkey
WHERE lower(c_name) LIKE '%00%' OR lower(c_mktsegment) LIKE '%auto%'""",
    "event_facets": """SELECT kind, status, count(*) AS n, CAST(grouping(status) AS INT) AS level
FROM (SELECT CASE WHEN value > 50 THEN 'video' ELSE 'image' END AS kind, event_type AS status FROM events WHERE contains(lower(props), '"k"'))
GROUP BY GROUPING SETS ((kind), (kind, status))""",
    "dashboard_summary": """SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error') AS n_error,
  count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, round(coalesce(avg(coalesce(value, 0)), 0), 4) AS mean_quality FROM events""",
    "nested_failed_items": "SELECT l_orderkey, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS INT) AS failed FROM lineitem GROUP BY 1",
    "batch_totals": """SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed,
  CAST(sum(coalesce(l_quantity, 0)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_shipdate""",
    "newest_per_owner": """SELECT o_custkey, o_orderkey, place FROM (
  SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place FROM orders)
WHERE place <= 3""",
    "newest_jobs": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "storage_usage": f"""SELECT event_type AS area, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, max(age) AS oldest_days, count(*) FILTER (WHERE age > 30) AS expired
FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400) AS BIGINT) AS age FROM events) GROUP BY 1""",
    "signature": "SELECT count(*) AS n, CAST(max(floor(epoch(ts))) AS BIGINT) AS latest FROM events",
    "nested_source_counts": f"""WITH {SAMPLES_SQL} SELECT source, count(*) FILTER (WHERE status = 'approved') AS approved,
  count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM samples GROUP BY 1""",
    "age_labels": """SELECT CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' WHEN m < 10080 THEN (m // 1440) || 'd' ELSE 'older' END AS age, count(*) AS n
FROM (SELECT CAST(floor((epoch(TIMESTAMP '2024-01-08') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events) GROUP BY 1""",
    "latest_per_user_purpose": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    "latest_unused": "SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE NOT coalesce(value > 30, false) GROUP BY 1, 2",
    "best_attempt": """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, value DESC, event_id) AS place FROM events)
WHERE place = 1""",
    "retained_history": """SELECT user_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5""",
}
