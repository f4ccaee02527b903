"""Queries over answers of a model, and their SQL. Lineitem rows give the answers' parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import answers
from tidewell.sources.tables import table

KNOWN = {"dog": "dog", "puppy": "dog", "car": "car", "sports car": "car", "bus": "bus", "person": "person", "man": "person", "glass": "glass"}
EFFECTS = {"keep": "remove_bg", "erase": "remove_object"}
TARGETS = ["Puppy", "red_sports  car", "buses", "glass", "kite", "a man"]
KINDS = ["keep", "blur", "erase", "crop", "melt"]
# The texts are built alike by both engines; %s stands for the columns.
PARTS = {"t": ("l_partkey", TARGETS), "u": ("l_suppkey", TARGETS), "e": ("l_orderkey", KINDS)}


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, words: F.element_at(F.array(*map(F.lit, words)), (F.col(c) % len(words) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *(pick(*x).alias(k) for k, x in PARTS.items()))
    text = F.concat(
        F.lit('Sure:\n```json\n{"target": ["'), "t", F.lit('", "'), "u", F.lit('"], "effect": "'), "e", F.lit('", "intensity": '), (F.col("l_quantity") * 3 - 20).cast("int").cast("string"),
        F.lit('.5, "crop": "yes", "selector": {"position": "Left", "rank": '), F.col("l_linenumber").cast("string"), F.lit(', "count": null, "attributes": ["Red  Hat", "red hat", "blue_car"]}}\n```'),
    )
    return rows.withColumn("text", F.when(F.col("l_linenumber") == 7, "no answer").otherwise(text))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers beside right ones: the order's answer with its first target alone and intensity at least 40."""
    rows = answers.parsed(answered(spark, sf_dir), F.col("text"), KNOWN, EFFECTS)
    a = F.col("answer")
    gold = F.struct(F.slice(a["target"], 1, 1).alias("target"), a["effect"].alias("effect"), F.greatest(a["intensity"], F.lit(40)).alias("intensity"), a["crop"].alias("crop"), a["position"].alias("position"), F.lit(None).cast("int").alias("rank"), F.lit(1).alias("count"), F.reverse(a["attributes"]).alias("attributes"))
    none = F.struct(F.array(F.lit("dog")).alias("target"), F.lit("blur").alias("effect"), F.lit(15).alias("intensity"), F.lit(False).alias("crop"), F.lit(None).cast("string").alias("position"), F.lit(None).cast("int").alias("rank"), F.lit(1).alias("count"), F.array().cast("array<string>").alias("attributes"))
    return rows.withColumn("gold", F.when(a.isNull(), none).otherwise(gold))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.parsed(answered(spark, sf_dir), F.col("text"), KNOWN, EFFECTS)
    a = F.col("answer")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(a["target"], "+").alias("target"), *(a[c].alias(c) for c in ("effect", "intensity", "crop", "position", "rank", "count")), F.array_join(a["attributes"], "+").alias("attributes"))


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answer_lines(answers.parsed(answered(spark, sf_dir), F.col("text"), KNOWN, EFFECTS))


def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.scored(both(spark, sf_dir), "answer", "gold").withColumn("part", F.col("l_orderkey") % 3)
    return answers.field_accuracy(rows, "part").withColumnRenamed("count", "count_ok")


def vote_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("prompt_id"), (F.col("l_linenumber") - 1).alias("pos"))
    return rows.agg(F.max("l_returnflag").alias("set"), F.max("l_quantity").alias("answer"))


def winning_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("set"))
    return answers.winners(vote_sets(spark, sf_dir), won, "answer")


def asked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("agreed"))
    return answers.needed_samples(vote_sets(spark, sf_dir), rule).groupBy("set").agg(F.count("*").alias("n"))


def first_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.first_success(vote_sets(spark, sf_dir), "prompt_id", "pos", F.col("answer") > 25).select("prompt_id", "pos")


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "fallback").otherwise("failed")
    step = answers.next_step(status, F.col("l_linenumber") % 2, answers.hard_example(F.col("l_discount"), 0.03))
    return rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"))


def stray_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    context = F.concat(F.lit("10 20 30.5 "), F.col("n_chars").cast("string"))
    text = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("of 30.5 and 7, 42 or"), F.col("n_chars").cast("string"))
    return rows.select("doc_id", F.array_join(answers.stray_numbers(text, context), ",").alias("stray"))


ROUTES = {"money": ["license", "price"], "people": ["e-mail", "@", "the"], "greeting": ["the", "hello"]}


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(answers.route(F.col("text"), ROUTES, "overview").alias("route")).agg(F.count("*").alias("n"))


def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    lines = F.split(F.regexp_replace("text", r"([.,])", "\n"), "\n")
    return rows.select("conv_id", "turn", F.array_join(answers.clean_lines(lines, F.lit("none")), "|").alias("lines"))


def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    found = answers.similar_questions(F.col("text"), [("the", "a"), ("in", "at"), ("of", "for"), ("zz", "y"), ("e", "i")])
    return rows.select("item_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("variants"))


def account_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    name = F.substring(F.translate("c_name", "#", ""), F.lit(1), (F.col("c_custkey") % 12).cast("int"))
    return rows.select("c_custkey", answers.serial(F.col("c_name")).alias("serial"), answers.masked_email(F.concat(name, F.lit("@ex.org"))).alias("email"), answers.password_problem(name).alias("problem"))


def intensity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", answers.default_intensity(F.col("doc_id") % 100, F.col("text")).alias("intensity"))


def read_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("+09:00"))).when(F.col("event_id") % 3 == 1, base).otherwise("soon")
    return rows.select("event_id", F.date_format(answers.iso_time(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


QUERIES = {f.__name__: f for f in (
    parsed_answers, answer_lines, field_accuracy, winning_answers, asked_samples, first_provider, next_steps, stray_numbers, routed, kept_lines, question_variants, account_fields,
    intensity_labels, read_times,
)}


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


NAMED = {"Puppy": "dog", "red_sports  car": "car", "buses": "bus", "glass": "glass", "kite": "kite", "a man": "person"}
KIND = {"keep": "remove_bg", "blur": "blur", "erase": "remove_object", "crop": "crop", "melt": None}
T1, T2 = (f"{listed(list(NAMED.values()))}[1 + {c} % 6]" for c in ("l_partkey", "l_suppkey"))
ANSWERS = f"""answers AS (SELECT *, {T1} AS t1, {T2} AS t2, list_extract(['remove_bg', 'blur', 'remove_object', 'crop', NULL], 1 + l_orderkey % 5) AS eff,
  l_linenumber <> 7 AND l_orderkey % 5 <> 4 AS ok, CAST(least(greatest(trunc(CAST(CAST(CAST(l_quantity * 3 - 20 AS INT) AS VARCHAR) || '.5' AS DOUBLE)), 0), 100) AS INT) AS num FROM lineitem)"""
VOTES = "votes AS (SELECT l_orderkey AS prompt_id, l_linenumber - 1 AS pos, max(l_returnflag) AS s, max(l_quantity) AS answer FROM lineitem GROUP BY 1, 2)"
ORACLE_SQL = {
    "parsed_answers": f"""WITH {ANSWERS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ok THEN CASE WHEN t1 = t2 THEN t1 ELSE t1 || '+' || t2 END END AS target, CASE WHEN ok THEN eff END AS effect,
  CASE WHEN ok THEN num END AS intensity, CASE WHEN ok THEN true END AS crop, CASE WHEN ok THEN 'left' END AS position, CASE WHEN ok AND l_linenumber > 1 THEN l_linenumber END AS rank, CAST(NULL AS INT) AS count,
  CASE WHEN ok THEN 'red hat+blue car' END AS attributes FROM answers""",
    "answer_lines": f"""WITH {ANSWERS} SELECT '{{"target":["' || CASE WHEN t1 = t2 THEN t1 ELSE t1 || '","' || t2 END || '"],"effect":"' || eff || '","intensity":' || num || ',"crop":true,"selector":{{"position":"left","rank":'
  || CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) ELSE 'null' END || ',"count":null,"attributes":["red hat","blue car"]}}}}' AS line, count(*) AS n FROM answers WHERE ok GROUP BY 1""",
    "field_accuracy": f"""WITH {ANSWERS}, s AS (SELECT *, l_orderkey % 3 AS part, ok AND t1 = t2 AS a, ok AND num >= 40 AS i, ok AND l_linenumber = 1 AS r FROM answers)
SELECT part, count(*) AS n, round(avg(CAST(a AS INT)), 4) AS target, round(avg(CAST(ok AS INT)), 4) AS effect, round(avg(CAST(i AS INT)), 4) AS intensity, round(avg(CAST(ok AS INT)), 4) AS crop, round(avg(CAST(ok AS INT)), 4) AS position,
  round(avg(CAST(r AS INT)), 4) AS rank, round(avg(CAST(ok AS INT)), 4) AS count_ok, round(avg(CAST(ok AS INT)), 4) AS attributes, round(avg(CAST(a AND i AND r AS INT)), 4) AS exact, round(avg(CAST(ok AS INT)), 4) AS valid FROM s GROUP BY 1""",
    "winning_answers": f"""WITH {VOTES}, w AS (SELECT o_orderkey AS prompt_id, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END AS s FROM orders)
SELECT w.prompt_id, w.s AS "set", coalesce((SELECT arg_min(answer, pos) FROM votes v WHERE v.prompt_id = w.prompt_id AND v.s = w.s), z.zero) AS answer,
  NOT EXISTS (SELECT 1 FROM votes v WHERE v.prompt_id = w.prompt_id AND v.s = w.s) AS replaced FROM w JOIN (SELECT prompt_id, arg_min(answer, pos) AS zero FROM votes GROUP BY 1) z ON z.prompt_id = w.prompt_id""",
    "asked_samples": f"""WITH {VOTES}, r AS (SELECT v.*, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN NULL THEN NULL ELSE 'N' END AS h, o_orderkey, max(CASE WHEN pos = 0 THEN s END) OVER (PARTITION BY v.prompt_id) AS first FROM votes v LEFT JOIN orders ON o_orderkey = v.prompt_id)
SELECT s AS "set", count(*) AS n FROM r WHERE pos = 0 OR NOT coalesce(o_orderkey IS NOT NULL AND first = h, false) GROUP BY 1""",
    "first_provider": f"WITH {VOTES} SELECT prompt_id, min(pos) AS pos FROM votes WHERE answer > 25 GROUP BY 1",
    "next_steps": """SELECT CASE WHEN l_returnflag = 'N' AND NOT l_discount < 0.03 THEN 'effect_applier' WHEN l_returnflag = 'R' AND l_linenumber % 2 < 1 THEN 'retry_segmentor' ELSE 'feedback_then_effects' END AS step, count(*) AS n FROM lineitem GROUP BY 1""",
    "stray_numbers": """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CAST(doc_id AS VARCHAR), '42'], lambda x: x NOT IN ('10', '20', '30.5', CAST(n_chars AS VARCHAR), '1', '2', '3', '4', '5', '6', '7', '8', '9')))), ',') AS stray FROM documents""",
    "routed": """SELECT CASE WHEN greatest(a, b, c) = 0 THEN 'overview' WHEN a >= b AND a >= c THEN 'money' WHEN b >= c THEN 'people' ELSE 'greeting' END AS route, count(*) AS n FROM (
  SELECT CAST(contains(t, 'license') AS INT) + CAST(contains(t, 'price') AS INT) AS a, CAST(contains(t, 'e-mail') AS INT) + CAST(contains(t, '@') AS INT) + CAST(contains(t, 'the') AS INT) AS b,
    CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'hello') AS INT) AS c FROM (SELECT lower(text) AS t FROM documents)) GROUP BY 1""",
    "kept_lines": r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '[.,]', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' "''`')), lambda x: length(x) BETWEEN 8 AND 180 AND x <> 'none') AS xs FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i)[1:6], '|') AS lines FROM l""",
    "question_variants": """WITH v AS (SELECT item_id, list_filter([CASE WHEN contains(text, 'the') THEN replace(text, 'the', 'a') END, CASE WHEN contains(text, 'in') THEN replace(text, 'in', 'at') END, CASE WHEN contains(text, 'of') THEN replace(text, 'of', 'for') END,
  CASE WHEN contains(text, 'zz') THEN replace(text, 'zz', 'y') END, CASE WHEN contains(text, 'e') THEN replace(text, 'e', 'i') END], lambda x: x IS NOT NULL)[1:3] AS xs FROM benchmark) SELECT item_id, len(xs) AS n, array_to_string(xs, '|') AS variants FROM v""",
    "account_fields": r"""SELECT c_custkey, regexp_replace(upper(c_name), '[^\p{L}\p{N}]', '', 'g') AS serial,
  x[1:CASE WHEN length(x) > 2 THEN 2 ELSE least(length(x), 1) END] || repeat('*', greatest(2, length(x) - CASE WHEN length(x) > 2 THEN 2 ELSE least(length(x), 1) END)) || '@ex.org' AS email,
  CASE WHEN length(x) NOT BETWEEN 8 AND 64 THEN 'length' WHEN NOT (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '\d')) THEN 'kinds' END AS problem FROM (SELECT *, substring(replace(c_name, '#', ''), 1, c_custkey % 12) AS x FROM customer)""",
    "intensity_labels": r"SELECT doc_id, CASE WHEN regexp_matches(text, '\d') THEN doc_id % 100 ELSE 15 END AS intensity FROM documents",
    "read_times": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events",
}
