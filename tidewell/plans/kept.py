"""Queries of state, changes, sources and curation that came later, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import changes, curation, memory, state, voting
from tidewell.operators.latest import best_per_key
from tidewell.sources import text_files
from tidewell.sources.tables import SAMPLES_SQL, samples, table

DAY = 86400.0


def seconds(ts: str) -> Column:
    """Seconds of a time without zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)).cast("double")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "send").when(F.col("event_type") == "purchase", "right").otherwise("wrong")
    return table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("t"), (F.col("event_type") != "error").alias("right"), kind.alias("kind"), "value")


def sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.folded(timed(spark, sf_dir), "user_id", ["t", "event_id"], ["t"], state.limiter(2, 5 * DAY), "wait double")
    return out.select("event_id", F.round("wait", 3).alias("wait"))


def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.folded(timed(spark, sf_dir), "user_id", ["t", "event_id"], ["t", "right"], state.lockout(2, 10 * DAY), "outcome string").select("event_id", "outcome")


def code_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.folded(timed(spark, sf_dir), "user_id", ["t", "event_id"], ["t", "kind"], state.code_check(2, 20 * DAY, DAY), "outcome string").select("event_id", "outcome")


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.folded(timed(spark, sf_dir), "user_id", ["t", "event_id"], ["value"], state.smoothing(0.6, 30.0), "soft double")
    return out.select("event_id", F.round("soft", 4).alias("soft"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ("pending", "approved", "rejected", "deleted"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("job_id"), F.lit("request").alias("source"), status.alias("status"), F.when(status == "approved", "train").alias("split"), F.col("o_orderpriority").alias("answer"), F.lit(None).cast("string").alias("origin_id"))


def merged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    job = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    incoming = o.select(job.alias("job_id"), F.lit("like").alias("source"), F.when(F.col("o_orderstatus") == "F", "fixed").otherwise(F.col("o_orderpriority")).alias("answer"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("origin_id"))
    return changes.merged(requests(spark, sf_dir), incoming, "job_id")


def filled_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("prompt"), F.col("o_orderstatus").alias("owner"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("prompt"), F.when(F.col("l_linenumber") == 3, F.col("l_linestatus")).alias("owner"))
    return changes.filled(rows, o, "job_id", ["prompt", "owner"]).groupBy("prompt", "owner").agg(F.count("*").alias("n"))


def bulk_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).withColumn("has_answer", F.col("answer") != "5-LOW")
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("job_id")).distinct()
    return changes.bulk_outcomes(ids, rows, "job_id", "approve").groupBy("outcome").agg(F.count("*").alias("n"))


def buried_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    gone = rows.where("job_id % 5 = 0").select("job_id")
    left = changes.buried(rows, gone, "job_id", ["answer", "split"])
    again = changes.inserted(left, rows.where("job_id % 10 = 0"), "job_id")
    return again.groupBy("status", "answer").agg(F.count("*").alias("n"))


def user_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderstatus")
    owned, linked = changes.without_user(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), users, "user_id")
    return owned.unionByName(linked).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("user_id").alias("with_user"))


def replaced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("used_at"))
    new = codes.where("event_id % 7 = 0").select("user_id", "event_type", (F.col("event_id") + 1000000000).alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("used_at")).dropDuplicates(["user_id", "event_type"]).withColumn("event_id", F.lit(-1).cast("long"))
    out = changes.replaced_active(codes, new, ["user_id", "event_type"], "used_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("used_at").isNull()).alias("open"))


def unlinked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/img/"), "p_brand", F.lit("/"), (F.col("p_partkey") % 10).cast("string"), F.lit(".png")).alias("path"))
    names = table(spark, sf_dir, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".png")).alias("name"))
    return changes.unpathed(rows, names, "path", "name").groupBy("path").agg(F.count("*").alias("n"))


def copied_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = text_files.missing_rows(o, o.where("o_orderkey % 3 = 0").drop("o_totalprice").withColumn("note", F.lit("old")), "o_orderkey")
    return out.groupBy("o_orderstatus", "note").agg(F.count("*").alias("n"))


def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return text_files.refreshed(o, o.where("o_orderkey % 4 <> 0"), "o_orderkey")[1]


def named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), F.lpad(((F.col("p_partkey") * 7) % 40).cast("string"), 4, "0"))).otherwise("")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("job"), (F.col("p_partkey") % 10000).alias("index"), F.concat(F.substring("p_brand", 1, 7), mark, F.lit(".png")).alias("name"))
    return text_files.safe_names(rows, "job", "index", "name").select("job", "index", "out_name")


def label_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, m: (F.col(c) % m).cast("string")
    line = F.concat_ws(" ", n("l_partkey", 4), n("l_suppkey", 9), F.lit("0.5 0.25"), n("l_orderkey", 7), F.when(F.col("l_linenumber") > 2, F.lit("1 0")), F.when(F.col("l_linenumber") > 4, F.lit("0.75 1")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return text_files.polygon_lines(rows, "l_orderkey", "text", {0: 7, 2: 5}).groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.size("points")).alias("values"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.run_manifest(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 2)


def pseudo_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(F.lit("user"), F.lit(None), F.lit("model")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), F.when(F.col("doc_id") % 2 == 0, "dislike").alias("vote"))
    return curation.with_default_source(rows).groupBy("source", "vote").agg(F.count("*").alias("n"))


def vote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("vote", F.when(F.col("lang") != "en", F.col("lang")))
    return curation.vote_summary(rows, F.col("status") == "approved", F.col("doc_id") % 2 == 0)


def template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.template_corpus(table(spark, sf_dir, "part"), {"erase the {}": 3, "keep {} only": 2, "blur all but {}": 1}, "p_partkey", "p_type")


def replay_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    out = curation.replay_mix(o.where("o_orderpriority = '1-URGENT'"), o, o.where("o_orderkey % 5 = 0"), "o_orderkey", 0.25)
    return out.groupBy("stream").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("sum"))


def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.review_cases(samples(spark, sf_dir).withColumn("score", F.col("n_chars") % 100), "doc_id", "score", 20, 60)


def class_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.class_prompts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["keep {}", "remove {}"])


def downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose download didn't fail."""
    failed = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(failed, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def detector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scenario"))
    new = rows.agg(F.avg((F.col("l_quantity") > 20).cast("double")).alias("pick"), F.avg((F.col("l_discount") > 0.07).cast("double")).alias("leak"))
    old = rows.agg(F.avg((F.col("l_quantity") > 21).cast("double")).alias("pick"), F.avg((F.col("l_discount") > 0.03).cast("double")).alias("leak"))
    return curation.vision_accepted(new, old, 0.001, ["N", "R"])


def eval_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of several evaluation sets' keys."""
    a, b = (table(spark, sf_dir, x).select(F.col(k).alias("key")) for x, k in (("benchmark", "text"), ("region", "r_name")))
    return a.union(b).union(table(spark, sf_dir, "nation").select("n_name")).distinct()


def one_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 7")


def split_rows(spark: SparkSession, sf_dir: str, split: str | None = "train") -> DataFrame:
    """Approved rows of one split, or of all without one."""
    rows = requests(spark, sf_dir).where("status = 'approved'")
    return (rows if split is None else rows.where(F.col("split") == split)).select("job_id", "answer")


def newest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback of one order, newest first, as places."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey <= 40")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), F.desc("l_linenumber"), "l_partkey", "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("place"))


def quota_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses per day without refunded ones."""
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time per stage: total, runs and mean."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.count("value").alias("runs"), F.avg("value").alias("mean"))
    return rows.select("event_type", F.round("total", 3).alias("total"), "runs", F.round("mean", 4).alias("mean"))


def job_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as a client sees them: defaults for nulls, a path as address."""
    url = F.concat(F.lit("/api/files/"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("pending")).alias("status"), F.when(F.col("o_totalprice") > 1000, url).alias("url"))


def best_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score per normal key of two stores; of ties the first store, then the first place."""
    rows = table(spark, sf_dir, "lineitem").select(F.lower(F.concat("l_returnflag", F.lit(" "), (F.col("l_partkey") % 50).cast("string"))).alias("key"), (F.col("l_quantity") % 7).alias("score"), (F.col("l_suppkey") % 2).alias("store"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"))
    out = best_per_key(rows, ["key"], [F.desc("score"), F.asc("store"), F.asc("pos")])
    return out.select("key", "score", "store", "pos.l_orderkey")


def rescored_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of the first three answers of a prompt, judged against the right set."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("answer"))
    none = rows.select("prompt_id", "answer").where("false")
    won = voting.majority(rows, none).join(table(spark, sf_dir, "orders"), F.col("prompt_id") == F.col("o_orderkey"))
    gold = F.array(F.when(F.col("o_orderstatus") == "F", "R").otherwise("N"))
    return won.groupBy(voting.confusion(F.array("answer"), gold).alias("kind")).agg(F.count("*").alias("n"))


def memory_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word hits first, then unseen vector hits, three at most per question."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("q"), (F.col("l_partkey") % 30).alias("memory"), (F.col("l_suppkey") % 2).alias("way"), F.col("l_quantity").alias("score"))
    best = rows.groupBy("q", "memory", "way").agg(F.max("score").alias("score"))
    first = best_per_key(best, ["q", "memory"], [F.asc("way")])
    w = Window.partitionBy("q").orderBy("way", F.desc("score"), "memory")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("q", "memory", "place")


def remembered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 16 stores hold after every question of the conversations and the turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"))
    none = F.array().cast("array<string>")
    rows = turns.where("role = 'user'").select((F.col("conv_id") % 16).alias("store"), "conv_id", "turn", "question", "answer", none.alias("similar"), none.alias("sources"))
    order = ["conv_id", "turn"]
    return memory.stored(memory.remembered(rows, "store", order), "store", order).select("store", "number", "item_id", "question", "answer", F.array_join("similar", "|").alias("similar"))


QUERIES = {f.__name__: f for f in (
    sliding_limiter, login_lockout, code_outcomes, smoothed, merged_requests, filled_feedback, bulk_review, buried_samples, user_removed, replaced_codes, unlinked_images, copied_missing, stale_keys,
    named_results, label_polygons, manifest, pseudo_sources, vote_summary, template_texts, replay_mix, review_cases, class_prompts, downloaded, detector_gate, eval_keys, one_order, split_rows,
    newest_feedback, quota_rollup, stage_times, job_cards, best_answers, rescored_rounds, memory_hits, remembered_items,
)}

TIMED = """e AS (SELECT user_id, event_id, floor(epoch(ts)) AS t, event_type <> 'error' AS r, CASE event_type WHEN 'signup' THEN 'send' WHEN 'purchase' THEN 'right' ELSE 'wrong' END AS kind, value,
  row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events)"""
REQUESTS = """requests AS (SELECT o_orderkey AS job_id, 'request' AS source, ['pending', 'approved', 'rejected', 'deleted'][1 + o_custkey % 4] AS status, CASE WHEN o_custkey % 4 = 1 THEN 'train' END AS split,
  o_orderpriority AS answer, CAST(NULL AS VARCHAR) AS origin_id FROM orders)"""
ORACLE_SQL = {
    "sliding_limiter": f"""WITH RECURSIVE {TIMED}, f AS (SELECT user_id, event_id, k, [t] AS q, 0.0::DOUBLE AS wait FROM e WHERE k = 1 UNION ALL
  SELECT user_id, event_id, k, CASE WHEN len(p) < 2 THEN list_append(p, t) ELSE p END, CASE WHEN len(p) < 2 THEN 0 ELSE greatest(0.1, 432000 - (t - p[1])) END FROM (
    SELECT e.user_id, e.event_id, e.k, e.t, list_filter(f.q, lambda x: e.t - x < 432000) AS p FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT event_id, round(wait, 3) AS wait FROM f""",
    "login_lockout": f"""WITH RECURSIVE {TIMED}, s AS (SELECT user_id, k, event_id, t, r, CASE WHEN r THEN 0 ELSE 1 END AS n, CAST(NULL AS DOUBLE) AS until, CASE WHEN r THEN 'ok' ELSE 'failed' END AS outcome FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.k, e.event_id, e.t, e.r, CASE WHEN s.until > e.t THEN s.n WHEN e.r OR s.n + 1 >= 2 THEN 0 ELSE s.n + 1 END,
    CASE WHEN s.until > e.t THEN s.until WHEN e.r THEN NULL WHEN s.n + 1 >= 2 THEN e.t + 864000 ELSE s.until END, CASE WHEN s.until > e.t THEN 'locked' WHEN e.r THEN 'ok' ELSE 'failed' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) SELECT event_id, outcome FROM s""",
    "code_outcomes": f"""WITH RECURSIVE {TIMED}, s AS (SELECT user_id, k, event_id, CASE WHEN kind = 'send' THEN t END AS sent, 0 AS tries, CASE WHEN kind = 'send' THEN 'sent' ELSE 'invalid' END AS outcome FROM e WHERE k = 1 UNION ALL
  SELECT user_id, k, event_id, CASE outcome WHEN 'sent' THEN t WHEN 'ok' THEN NULL ELSE sent END, CASE WHEN outcome IN ('sent', 'ok') THEN 0 WHEN counted THEN tries + 1 ELSE tries END, outcome FROM (
    SELECT *, CASE WHEN kind = 'send' THEN CASE WHEN t - sent < 86400 THEN 'wait' ELSE 'sent' END WHEN NOT live THEN 'invalid' WHEN kind = 'right' THEN 'ok' WHEN tries + 1 < 2 THEN 'wrong' ELSE 'invalid' END AS outcome,
      kind = 'wrong' AND live AS counted FROM (SELECT e.user_id, e.k, e.event_id, e.t, e.kind, s.sent, s.tries, coalesce(e.t - s.sent < 1728000 AND s.tries < 2, false) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT event_id, outcome FROM s""",
    "smoothed": f"""WITH RECURSIVE {TIMED}, s AS (SELECT user_id, k, event_id, value, value AS soft FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.k, e.event_id, e.value, CASE WHEN abs(e.value - s.value) > 30 THEN e.value ELSE 0.6 * e.value + 0.4 * s.soft END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) SELECT event_id, round(soft, 4) AS soft FROM s""",
    "merged_requests": f"""WITH {REQUESTS}, i AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS job_id, CASE o_orderstatus WHEN 'F' THEN 'fixed' ELSE o_orderpriority END AS answer, 'f' || o_orderkey AS origin_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(r.job_id, i.job_id) AS job_id, CASE WHEN i.job_id IS NOT NULL AND r.status IS DISTINCT FROM 'deleted' THEN 'like' ELSE r.source END AS source,
  CASE WHEN r.job_id IS NULL OR (i.job_id IS NOT NULL AND r.status <> 'deleted' AND i.answer <> r.answer) THEN 'pending' ELSE r.status END AS status,
  CASE WHEN i.job_id IS NOT NULL AND r.status NOT IN ('deleted', 'pending') AND i.answer <> r.answer THEN NULL ELSE r.split END AS split,
  CASE WHEN i.job_id IS NOT NULL AND r.status IS DISTINCT FROM 'deleted' THEN i.answer ELSE r.answer END AS answer, CASE WHEN r.status IS DISTINCT FROM 'deleted' THEN i.origin_id END AS origin_id
FROM requests r FULL JOIN i ON r.job_id = i.job_id""",
    "filled_feedback": """SELECT coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, o_orderpriority) AS prompt, coalesce(CASE WHEN l_linenumber = 3 THEN l_linestatus END, o_orderstatus) AS owner, count(*) AS n
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "bulk_review": f"""WITH {REQUESTS} SELECT CASE WHEN r.status IS NULL THEN 'missing' WHEN r.status = 'deleted' THEN 'deleted' WHEN r.answer = '5-LOW' THEN 'no_answer' ELSE 'done' END AS outcome, count(*) AS n
FROM (SELECT DISTINCT l_orderkey * 2 AS job_id FROM lineitem) i LEFT JOIN requests r USING (job_id) GROUP BY 1""",
    "buried_samples": f"WITH {REQUESTS} SELECT CASE WHEN job_id % 5 = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN job_id % 5 <> 0 THEN answer END AS answer, count(*) AS n FROM requests GROUP BY 1, 2",
    "user_removed": """SELECT o_orderstatus, count(*) AS n, count(CASE WHEN c_nationkey IS DISTINCT FROM 3 THEN o_custkey END) AS with_user FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'F' OR c_nationkey IS DISTINCT FROM 3 GROUP BY 1""",
    "replaced_codes": """WITH n AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 7 = 0)
SELECT event_type, count(*) AS n, count(*) FILTER (still) AS open FROM (SELECT e.event_type, event_id % 3 <> 0 AND n.user_id IS NULL AS still FROM events e LEFT JOIN n ON e.user_id = n.user_id AND e.event_type = n.event_type
  UNION ALL SELECT event_type, true FROM n) GROUP BY 1""",
    "unlinked_images": "SELECT CASE WHEN p_partkey % 10 > 4 THEN '/img/' || p_brand || '/' || (p_partkey % 10) || '.png' END AS path, count(*) AS n FROM part GROUP BY 1",
    "copied_missing": "SELECT o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END AS note, count(*) AS n FROM orders GROUP BY 1, 2",
    "stale_keys": "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0",
    "named_results": """WITH f AS (SELECT p_size AS job, p_partkey % 10000 AS index, p_brand[1:7] || CASE WHEN p_partkey % 3 = 0 THEN '_' || lpad(CAST(p_partkey * 7 % 40 AS VARCHAR), 4, '0') ELSE '' END AS stem FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY job, stem ORDER BY index) AS place, stem || '_' || lpad(CAST(index AS VARCHAR), 4, '0') AS numbered FROM f)
SELECT job, index, CASE WHEN place = 1 THEN stem WHEN EXISTS (SELECT 1 FROM f WHERE f.job = r.job AND f.stem = r.numbered) THEN numbered || '_' || md5(CAST(index AS VARCHAR)) ELSE numbered END || '_result.png' AS out_name FROM r""",
    "label_polygons": """SELECT cls, count(*) AS n, CAST(sum(n) AS BIGINT) AS values FROM (SELECT CASE l_partkey % 4 WHEN 0 THEN 7 WHEN 2 THEN 5 END AS cls, 4 + CASE WHEN l_linenumber > 2 THEN 2 ELSE 0 END + CASE WHEN l_linenumber > 4 THEN 2 ELSE 0 END AS n
  FROM lineitem) WHERE n >= 6 AND cls IS NOT NULL GROUP BY 1""",
    "manifest": """SELECT '{"records":' || (SELECT count(*) FROM documents) || ',"counts":{' || (SELECT string_agg('"' || lang || '":' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) || '},"samples":[' ||
  (SELECT string_agg('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}', ',' ORDER BY doc_id) FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 2)) || ']}' AS manifest""",
    "pseudo_sources": "SELECT CASE doc_id % 3 WHEN 2 THEN 'model' ELSE 'pseudo' END AS source, CASE doc_id % 2 WHEN 0 THEN 'dislike' ELSE 'like' END AS vote, count(*) AS n FROM documents GROUP BY 1, 2",
    "vote_summary": f"""WITH {SAMPLES_SQL}, v AS (SELECT CASE lang WHEN 'en' THEN 'none' ELSE lang END AS v, count(*) AS n, count(*) FILTER (status = 'approved') AS u, count(*) FILTER (doc_id % 2 = 0) AS i FROM samples GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS cases, CAST(sum(u) AS BIGINT) AS records, CAST(sum(n) - sum(u) AS BIGINT) AS skipped, CAST(sum(i) AS BIGINT) AS with_image, string_agg(v || ':' || n, ',' ORDER BY v) AS votes FROM v""",
    "review_cases": f"WITH {SAMPLES_SQL} SELECT doc_id, n_chars % 100 AS score FROM samples WHERE status = 'pending' AND n_chars % 100 >= 20 AND n_chars % 100 < 60",
    "downloaded": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0) GROUP BY 1",
    "detector_gate": """SELECT count(*) FILTER (p < p0 - 0.02 OR l > l0 + 0.02) AS worse, count(*) FILTER (s IN ('N', 'R') AND (l < l0 - 0.02 OR p > p0 + 0.02)) AS better,
  count(*) FILTER (p < p0 - 0.02 OR l > l0 + 0.02) = 0 AND count(*) FILTER (s IN ('N', 'R') AND (l < l0 - 0.02 OR p > p0 + 0.02)) > 0 AS accepted FROM (
  SELECT l_returnflag AS s, avg(CAST(l_quantity > 20 AS INT)) AS p, avg(CAST(l_discount > 0.07 AS INT)) AS l, avg(CAST(l_quantity > 21 AS INT)) AS p0, avg(CAST(l_discount > 0.03 AS INT)) AS l0 FROM lineitem GROUP BY 1)""",
    "eval_keys": "SELECT text AS key FROM benchmark UNION SELECT r_name FROM region UNION SELECT n_name FROM nation",
    "one_order": "SELECT * FROM orders WHERE o_orderkey = 7",
    "split_rows": f"WITH {REQUESTS} SELECT job_id, answer FROM requests WHERE status = 'approved' AND split = 'train'",
    "newest_feedback": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_orderkey <= 40",
    "quota_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
    "stage_times": "SELECT event_type, round(sum(value), 3) AS total, count(value) AS runs, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "job_cards": "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 1000 THEN '/api/files/' || o_orderkey || '.png' END AS url FROM orders",
    "best_answers": """SELECT key, score, store, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, store, l_orderkey, l_linenumber, l_partkey) AS place FROM (
  SELECT *, lower(l_returnflag || ' ' || (l_partkey % 50)) AS key, l_quantity % 7 AS score, l_suppkey % 2 AS store FROM lineitem)) WHERE place = 1""",
    "rescored_rounds": """WITH c AS (SELECT l_orderkey AS p, l_returnflag AS a, count(*) AS n, min(l_linenumber) AS f FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
w AS (SELECT p, a FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, f, a) AS place FROM c) WHERE place = 1)
SELECT CASE WHEN a = CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END THEN 'ok' ELSE 'wrong' END AS kind, count(*) AS n FROM w JOIN orders ON p = o_orderkey GROUP BY 1""",
    "memory_hits": """WITH b AS (SELECT l_orderkey % 100 AS q, l_partkey % 30 AS memory, l_suppkey % 2 AS way, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, memory ORDER BY way) AS k FROM b) WHERE k = 1)
SELECT q, memory, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY way, score DESC, memory) AS place FROM f) WHERE place <= 3""",
}
