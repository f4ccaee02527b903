"""Queries of the selection, voting, evaluation, time and change families, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import sha1_remainder, sha1_remainder_sql, split_name
from tidewell.operators import changes, evaluation, selection, segments, temporal, voting
from tidewell.sources.tables import SAMPLES_SQL, samples, table


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("cx"))


def position_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.salient(instances(spark, sf_dir), "l_orderkey", F.col("area"))
    placed = selection.ordered(rows, "l_orderkey", [F.asc("cx"), F.asc("l_linenumber")])
    return selection.slice_of(placed, None, 1).select("l_orderkey", "l_linenumber")


def rank_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = selection.ordered(instances(spark, sf_dir), "l_orderkey", [F.desc("area"), F.asc("l_linenumber")])
    return selection.slice_of(placed, 3, 2).select("l_orderkey", "l_linenumber", "place")


def ambiguous_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ambiguous(instances(spark, sf_dir), "l_orderkey", F.col("area"), "l_linenumber", 0.1).select("l_orderkey", "l_linenumber", "unsure")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("answer"))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("answer"))
    return voting.majority(votes(spark, sf_dir), rule)


def vote_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.stability(votes(spark, sf_dir)).withColumn("share", F.round("share", 4))


def always_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.always_wrong(votes(spark, sf_dir), F.col("answer") == "N")


def set_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("gold"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("pred"))
    pred = F.when(F.size("pred") > 0, F.col("pred"))
    return rows.select(voting.confusion(pred, F.col("gold")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return evaluation.threshold_sweep(rows, F.col("l_quantity") / 50, F.col("l_returnflag") == "R", [0.2, 0.35, 0.5], "l_linestatus")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", 0.95).withColumnRenamed("value", "p95")


def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("level"), "value", F.col("event_type").alias("status"))
    return evaluation.latency_report(rows, "level", "value", "status").withColumn("p50", F.round("p50", 6))


def weighted_mean_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return sets.agg(F.round(evaluation.weighted_mean(sets, "mean", "n"), 4).alias("mean"))


def accept_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    new, old = (e.where(f"user_id % 2 = {r}").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("correct")) for r in (0, 1))
    return evaluation.accepted(new, old)


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    score = evaluation.quality_score(F.col("l_quantity") / 50, 1 - F.col("l_discount") * 10, 0.5)
    return rows.select("l_orderkey", "l_linenumber", F.round(score, 4).alias("score"))


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.daily_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1)
    return rows.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "allowed")


def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.expired(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.progress(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")
    return rows.select("l_orderkey", "l_linenumber", "completed", "failed", "progress", "status")


def hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return segments.hold_last(rows, "user_id", ["ts", "event_id"], F.when(F.col("value") > 20, F.col("value")), "held").select("event_id", F.round("held", 4).alias("held"))


def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sha1_remainder(F.col("doc_id").cast("string"))
    rows = samples(spark, sf_dir).select(
        "doc_id", "status", F.when(F.col("status") == "approved", "train").alias("split"), split_name(F.col("doc_id").cast("string")).alias("new_split"), (F.col("lang") != "de").alias("has_answer"), r.alias("r")
    )
    action = F.when(F.col("r") < 3, "approve").when(F.col("r") == 3, "reject").when(F.col("r") == 4, "reset").when(F.col("r") == 5, "delete")
    actions = rows.where("r < 6").select("doc_id", action.alias("action"))
    return changes.reviewed(rows, actions, "doc_id").select("doc_id", "status", "split")


def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = rows.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("done").alias("o_orderstatus"))
    return changes.upserted(rows, new, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    position_pick, rank_slice, ambiguous_neighbours, majority_vote, vote_stability, always_wrong, set_confusion, threshold_sweep, latency_percentiles, latency_report, weighted_mean_by_set,
    accept_candidate, quality_score, daily_quota, ttl_expired, batch_progress, hold_last, review_transitions, upserted_orders,
)}

R = sha1_remainder_sql("CAST(doc_id AS VARCHAR)")
ORACLE_SQL = {
    "position_pick": """SELECT l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS place FROM (
    SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE l_quantity >= 0.2 * top) WHERE place = 1""",
    "rank_slice": """SELECT l_orderkey, l_linenumber, place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS INT) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
WHERE place >= least(3, n) AND place < least(3, n) + 2""",
    "ambiguous_neighbours": """SELECT l_orderkey, l_linenumber, coalesce(abs(a - b) / greatest(a, b, 1e-9) < 0.1, false) OR coalesce(abs(a - c) / greatest(a, c, 1e-9) < 0.1, false) AS unsure FROM (
  SELECT *, l_quantity AS a, lag(l_quantity) OVER w AS b, lead(l_quantity) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber))""",
    "majority_vote": """WITH s AS (SELECT l_orderkey AS prompt_id, count(*) AS n_samples FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS prompt_id, l_returnflag AS answer, count(*) AS own, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2),
h AS (SELECT prompt_id, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END AS answer, 1 AS extra FROM orders JOIN s ON o_orderkey = prompt_id WHERE n_samples > 1),
b AS (SELECT prompt_id, answer, coalesce(own, 0) AS own, coalesce(extra, 0) AS extra, first FROM c FULL JOIN h USING (prompt_id, answer)),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY own + extra DESC, own DESC, first NULLS LAST, answer) AS place FROM b)
SELECT prompt_id, answer, n_samples, CASE WHEN own = 0 THEN 'heuristic' WHEN n_samples > 1 THEN 'vote' ELSE 'llm' END AS decided_by FROM r JOIN s USING (prompt_id) WHERE place = 1""",
    "vote_stability": "SELECT count(*) AS n, round(avg(CAST(d = 1 AS INT)), 4) AS share FROM (SELECT count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY l_orderkey)",
    "always_wrong": "SELECT l_orderkey AS prompt_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'N')",
    "set_confusion": """SELECT CASE WHEN p = 0 THEN 'invalid' WHEN p = g THEN 'ok' ELSE 'missing' END AS kind, count(*) AS n FROM (
  SELECT count(DISTINCT l_returnflag) AS g, count(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 10) AS p FROM lineitem GROUP BY l_orderkey) GROUP BY 1""",
    "threshold_sweep": """SELECT threshold, l_linestatus, round(tp / greatest(pos, 1), 3) AS recall, round(fp / greatest(neg, 1), 3) AS false_rate, round(tp / greatest(tp + fp, 1), 3) AS precision FROM (
  SELECT threshold, l_linestatus, count(*) FILTER (WHERE p) AS pos, count(*) FILTER (WHERE NOT p) AS neg, count(*) FILTER (WHERE p AND s >= threshold) AS tp, count(*) FILTER (WHERE NOT p AND s >= threshold) AS fp
  FROM (SELECT l_linestatus, l_quantity / 50 AS s, l_returnflag = 'R' AS p, unnest([0.2, 0.35, 0.5]::DOUBLE[]) AS threshold FROM lineitem) GROUP BY GROUPING SETS ((threshold), (threshold, l_linestatus)))""",
    "latency_percentiles": """SELECT event_type, value AS p95 FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
WHERE r = round_even(0.95 * (n - 1), 0)""",
    "latency_report": """WITH e AS (SELECT user_id % 5 AS level, value, event_type AS status FROM events), c AS (SELECT level, status, count(*) AS c FROM e GROUP BY ALL),
p AS (SELECT level, value, row_number() OVER (PARTITION BY level ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY level) AS n FROM e WHERE value IS NOT NULL)
SELECT level, (SELECT CAST(sum(c) AS BIGINT) FROM c WHERE c.level = p.level) AS requests, round(avg(value) FILTER (r = (n - 1) // 2 OR r = n // 2), 6) AS p50, avg(value) FILTER (r = round_even(0.95 * (n - 1), 0)) AS p95, max(value) AS max,
(SELECT '{' || string_agg('"' || status || '":' || c, ',' ORDER BY status) || '}' FROM c WHERE c.level = p.level) AS statuses FROM p GROUP BY level""",
    "weighted_mean_by_set": "SELECT round(sum(mean * n) / greatest(sum(n), 1), 4) AS mean FROM (SELECT avg(value) AS mean, count(*) AS n FROM events GROUP BY event_type)",
    "accept_candidate": """SELECT count(*) AS sets, CAST(sum(a - b) AS BIGINT) AS gain, max(b - a) AS worst, max(b - a) <= 1 AND sum(a - b) > 0 AS accepted FROM (
  SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS a, count(*) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY event_type) WHERE a > 0 AND b > 0""",
    "quality_score": """SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.5 * greatest(0, least(1, 1 - abs(l_quantity / 50 - 0.35) / 0.65)) + 0.5 * least(1, (1 - l_discount * 10) / 0.5))), 4) AS score FROM lineitem""",
    "daily_quota": """SELECT event_id, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) <= 1 AS allowed
FROM (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events)""",
    "ttl_expired": "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY GROUP BY 1",
    "batch_progress": """SELECT l_orderkey, l_linenumber, completed, failed, progress, CASE WHEN progress < 1 THEN 'running' WHEN failed = completed THEN 'failed' ELSE 'done' END AS status FROM (
  SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS INT) AS completed, CAST(sum(CAST(l_returnflag = 'R' AS INT)) OVER w AS BIGINT) AS failed,
    round(row_number() OVER w / count(*) OVER (PARTITION BY l_orderkey), 4) AS progress FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))""",
    "hold_last": """SELECT event_id, round(last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS held FROM events""",
    "review_transitions": f"""WITH {SAMPLES_SQL}, s AS (SELECT *, {R} AS r FROM samples)
SELECT doc_id, CASE WHEN r < 3 AND lang <> 'de' THEN 'approved' WHEN r = 3 THEN 'rejected' WHEN r = 4 THEN 'pending' WHEN r = 5 THEN 'deleted' ELSE status END AS status,
  CASE WHEN r < 3 AND lang <> 'de' THEN CASE WHEN status = 'approved' THEN 'train' WHEN r = 0 THEN 'val' ELSE 'train' END WHEN r BETWEEN 3 AND 5 THEN NULL WHEN status = 'approved' THEN 'train' END AS split FROM s""",
    "upserted_orders": "SELECT CASE o_orderstatus WHEN 'P' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
}
