"""Queries over boxes, cells and frames, and their SQL. Lineitem rows stand for boxes of an image, an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import selection, vision
from tidewell.sources.tables import table

SIDE = 120.0


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), ((F.col("l_suppkey") * 10000000 + F.col("l_partkey")) * 10 + F.col("l_linenumber")).alias("inst"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("l_quantity")).alias("x1"),
        (y + 5 + F.col("l_quantity") / 2).alias("y1"), F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("conf"),
    )


BOXES = """boxes AS (SELECT l_orderkey AS image, (l_suppkey * 10000000 + l_partkey) * 10 + l_linenumber AS inst, CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0,
  l_partkey % 60 + 10 + l_quantity AS x1, l_suppkey % 40 + 5 + l_quantity / 2 AS y1, l_returnflag AS label, l_discount * 10 AS conf FROM lineitem)"""
SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
AREA_A, AREA_B = ("(%s.x1 - %s.x0) * (%s.y1 - %s.y0)" % ((p,) * 4) for p in "ab")
IOU = f"({SHARED}) / ({AREA_A} + {AREA_B} - {SHARED})"


def split_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = boxes(spark, sf_dir)
    return rows.where("inst % 2 = 1"), rows.where("inst % 2 = 0")


def truth_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, truths = split_boxes(spark, sf_dir)
    rows = vision.best_overlap(preds, truths, "image", "inst", 0.5)
    return rows.agg(F.count("*").alias("truths"), F.count_if("found").alias("found"), F.round(F.count_if("found") / F.count("*"), 4).alias("recall"), F.round(F.avg("best"), 4).alias("best"))


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, truths = split_boxes(spark, sf_dir)
    return vision.unmatched(preds.where(vision.box_area("") >= vision.LARGE * SIDE * SIDE), truths, "image", "inst").groupBy("label").agg(F.count("*").alias("n"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = split_boxes(spark, sf_dir)
    return vision.side_by_side(a, b, "image", ["inst", "label"]).where("a_label = b_label").select("image", "a_inst", "b_inst", vision.iou("a_", "b_").alias("score"))


def row_order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.matched(scored_pairs(spark, sf_dir), "image", "a_inst", "b_inst", "score", True).withColumn("score", F.round("score", 6))


def score_order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.matched(scored_pairs(spark, sf_dir), "image", "a_inst", "b_inst", "score", False).withColumn("score", F.round("score", 6))


def hard_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.hard_images(boxes(spark, sf_dir), "image", SIDE, SIDE)


def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.size_kinds(boxes(spark, sf_dir), "image", vision.box_area(""), SIDE * SIDE).groupBy("label", "large").agg(F.count("*").alias("n"))


def attribute_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("share", F.col("conf") / 10)
    return vision.attribute_cut(rows, "image", "share", "inst").select("image", "inst")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.best_first(boxes(spark, sf_dir).withColumn("id", F.struct("image", "inst")), "label", "conf", "id", 300).select("image", "inst", "label", F.col("place").cast("long").alias("place"))


def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vision.padded_box(boxes(spark, sf_dir), 0.1, 100, 60)
    ratio = vision.area_ratio(vision.box_area(""), F.lit(100.0), F.lit(60.0))
    return rows.select("image", "inst", *(F.round(c, 4).alias(c) for c in ("px0", "py0", "px1", "py1")), F.round(ratio, 6).alias("ratio"))


def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", vision.letterbox(F.col("p_size") * 10 + 1, F.col("p_partkey") % 700 + 3, 640).alias("fit"))
    return rows.select("p_partkey", F.round("fit.scale", 6).alias("scale"), "fit.top", "fit.left", "fit.bottom", "fit.right")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    point = lambda x, y: F.struct((F.col(x) - 5).alias("x"), F.col(y).alias("y"))
    shape = F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"))
    return rows.select("image", "inst", vision.normal_polygon(shape, 80.0, 50.0).alias("p")).select("image", "inst", *(F.get("p", F.lit(k))[c].alias(f"{c}{k}") for k in range(3) for c in "xy"))


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value")


def thinned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.thinned(clip_frames(spark, sf_dir), "user_id", "event_id", 3).select("user_id", "event_id")


def late_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.last_third(clip_frames(spark, sf_dir), "user_id", "event_id", F.col("value")).withColumn("late", F.round("late", 4))


def camera_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.camera_mode(vision.frame_changes(clip_frames(spark, sf_dir), "user_id", ["event_id"], F.col("value")), "user_id", 15, 40)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 17).alias("x"), (F.col("l_suppkey") % 13).alias("y"), (F.col("l_quantity") > 20).alias("mask"),
        (F.col("l_returnflag") == "N").alias("target"), (F.col("l_returnflag") == "R").alias("others"),
    )


def mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.mask_scores(cells(spark, sf_dir), "image").select("image", *(F.round(c, 4).alias(c) for c in ("leak", "iou", "cover")), "empty")


def leak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vision.leak_summary(vision.mask_scores(cells(spark, sf_dir), "image"))
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("leak", "over5", "over15")), "empties")


def mask_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("cell", F.col("x") * 13 + F.col("y"))
    return vision.subtracted(rows, rows.where("others"), "image", "cell").groupBy("image").agg(F.count("*").alias("n"), F.sum("cell").alias("sum"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.centre_and_box(cells(spark, sf_dir), "image").withColumns({"cx": F.round("cx", 4), "cy": F.round("cy", 4)})


def largest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("area", vision.box_area(""))
    return vision.largest_parts(rows, "image", "area", "inst", SIDE * SIDE, 2, 0.05).select("image", "inst", F.col("place").cast("long").alias("place"))


def group_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.group_probability(boxes(spark, sf_dir), "image", "conf", F.col("label") == "R").withColumn("probability", F.round("probability", 6))


def picture_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return vision.picture_errors(rows, "label", F.col("x1"), F.col("y1") * 2).select("label", *(F.round(c, 4).alias(c) for c in ("l1", "psnr", "soft_iou")))


def steady_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vision.steady_median(clip_frames(spark, sf_dir), "user_id", F.col("value"), F.col("value") > 10)
    return rows.select("user_id", "n", F.round("median", 4).alias("median"), F.round("plate", 4).alias("plate"))


def peer_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.peer_ratio(boxes(spark, sf_dir).withColumn("area", vision.box_area("")), "image", "area").withColumn("ratio", F.round("ratio", 4))


def paired_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vision.paired_bootstrap(boxes(spark, sf_dir).withColumn("id", F.struct("image", "inst")), "id", "x1", "y1", 200)
    return out.select("n", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.col("low").between(F.col("mean_b") - F.col("mean_a") - 5, F.col("high")).alias("ordered"))


POSITIONS = ("left", "right", "center", "largest", "smallest", "front", "back")


def every_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.with_position_keys(boxes(spark, sf_dir), "image", SIDE, SIDE)
    out = None
    for name in POSITIONS:
        one = selection.slice_of(selection.ordered(rows, "image", [F.col(f"by_{name}"), F.col("inst")]), None, 1).select("image", F.lit(name).alias("position"), "inst")
        out = one if out is None else out.unionByName(one)
    return out


def ordinal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenario cases: leftmost and second of images with two or more large boxes."""
    big = boxes(spark, sf_dir).where(vision.box_area("") >= vision.LARGE * SIDE * SIDE)
    placed = selection.ordered(big, "image", [F.col("x0") + F.col("x1"), F.col("inst")]).where("n >= 2 and place <= 2")
    return placed.select("image", "inst", F.when(F.col("place") == 1, "left").otherwise("rank2").alias("scenario"))


def selection_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.ambiguous(boxes(spark, sf_dir), "image", F.col("x0") + 1, "inst", 0.1, 0.03)
    kind, result = F.when(F.col("unsure"), "ambiguous").otherwise("clear"), F.when(F.col("conf") > 0.5, "ok").when(F.col("conf") > 0.2, "order").otherwise("miss")
    return rows.select(kind.alias("kind"), result.alias("result")).groupBy("kind").pivot("result", ["ok", "order", "miss"]).agg(F.count(F.lit(1))).na.fill(0)


def boundary_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("image", F.col("image") % 400)
    return vision.boundary_f(rows.where("mask"), rows.where("target or others"), "image", 17, 13).withColumn("f", F.round("f", 6))


QUERIES = {f.__name__: f for f in (
    truth_recall, false_positives, row_order_matches, score_order_matches, hard_images, size_filter, attribute_cut, best_candidates, padded_boxes, letterboxes, polygons, thinned_frames,
    late_mean, camera_modes, mask_scores, leak_summary, mask_difference, centres, largest_parts, group_probability, picture_errors, steady_values, peer_ratio, paired_means,
    every_position, ordinal_cases, selection_table, boundary_f,
)}

BEST = f"""{BOXES}, best AS (SELECT a.image, a.inst, coalesce(max({IOU}), 0) AS best FROM (SELECT * FROM boxes WHERE inst % 2 = 0) a LEFT JOIN (SELECT * FROM boxes WHERE inst % 2 = 1) b ON a.image = b.image GROUP BY 1, 2)"""
CELLS = """cells AS (SELECT l_orderkey AS image, l_partkey % 17 AS x, l_suppkey % 13 AS y, l_quantity > 20 AS m, l_returnflag = 'N' AS t, l_returnflag = 'R' AS o FROM lineitem)"""
SCORES = f"""{CELLS}, scores AS (SELECT image, CASE WHEN count(*) FILTER (m) = 0 THEN 0 ELSE count(*) FILTER (m AND o) / greatest(count(*) FILTER (m), 1) END AS leak,
  CASE WHEN count(*) FILTER (m) = 0 THEN 0 ELSE count(*) FILTER (m AND t) / greatest(count(*) FILTER (m OR t), 1) END AS iou,
  CASE WHEN count(*) FILTER (m) = 0 THEN 0 ELSE count(*) FILTER (m AND t) / greatest(count(*) FILTER (t), 1) END AS cover, count(*) FILTER (m) = 0 AS empty FROM cells GROUP BY 1)"""
AREA = "(x1 - x0) * (y1 - y0)"
CX, CY = "(x0 + x1) / 2", "(y0 + y1) / 2"
FRONT = f"(0.6 * y1 / 119.0 + 0.4 * ({AREA}) / max({AREA}) OVER (PARTITION BY image))"
POSITION_SQL = {"left": CX, "right": f"-({CX})", "center": f"abs({CX} - 60.0) + abs({CY} - 60.0)", "largest": f"-({AREA})", "smallest": AREA, "front": "-front", "back": "front"}
ORACLE_SQL = {
    "truth_recall": f"WITH {BEST} SELECT count(*) AS truths, count(*) FILTER (best >= 0.5) AS found, round(count(*) FILTER (best >= 0.5) / count(*), 4) AS recall, round(avg(best), 4) AS best FROM best",
    "false_positives": f"""WITH {BOXES} SELECT label, count(*) AS n FROM boxes a WHERE inst % 2 = 1 AND {AREA} >= 0.025 * 14400
  AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.image = a.image AND b.inst % 2 = 0 AND {IOU} >= 0.5) GROUP BY 1""",
    "hard_images": f"""WITH {BOXES}, big AS (SELECT * FROM boxes WHERE {AREA} >= 0.025 * 14400)
SELECT DISTINCT a.image FROM big a JOIN big b ON a.image = b.image AND a.inst < b.inst WHERE a.x0 - 2.4 < b.x1 AND b.x0 - 2.4 < a.x1 AND a.y0 - 2.4 < b.y1 AND b.y0 - 2.4 < a.y1""",
    "size_filter": f"""WITH {BOXES}, r AS (SELECT *, {AREA} / 14400 >= 0.025 AS large FROM boxes WHERE {AREA} / 14400 >= 0.003)
SELECT label, large, count(*) AS n FROM (SELECT *, bool_or(large) OVER (PARTITION BY image) AS keep FROM r) WHERE keep GROUP BY 1, 2""",
    "attribute_cut": f"""WITH {BOXES}, r AS (SELECT *, conf / 10 AS s, max(conf / 10) OVER (PARTITION BY image) AS best, row_number() OVER (PARTITION BY image ORDER BY conf DESC, inst) AS place FROM boxes)
SELECT image, inst FROM (SELECT *, s >= greatest(0.06, 0.5 * best) AS pass, bool_or(s >= greatest(0.06, 0.5 * best)) OVER (PARTITION BY image) AS any_pass FROM r) WHERE CASE WHEN any_pass THEN pass ELSE place = 1 END""",
    "best_candidates": f"WITH {BOXES} SELECT image, inst, label, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conf DESC, image, inst) AS place FROM boxes) WHERE place <= 300",
    "padded_boxes": f"""WITH {BOXES} SELECT image, inst, round(least(greatest(x0 - (x1 - x0) * 0.1, 0), 100), 4) AS px0, round(least(greatest(y0 - (y1 - y0) * 0.1, 0), 60), 4) AS py0,
  round(least(greatest(x1 + (x1 - x0) * 0.1, 0), 100), 4) AS px1, round(least(greatest(y1 + (y1 - y0) * 0.1, 0), 60), 4) AS py1, round({AREA} / 6000, 6) AS ratio FROM boxes""",
    "letterboxes": """SELECT p_partkey, round(r, 6) AS scale, CAST(round_even(dh - 0.1, 0) AS INT) AS top, CAST(round_even(dw - 0.1, 0) AS INT) AS "left", CAST(round_even(dh + 0.1, 0) AS INT) AS bottom, CAST(round_even(dw + 0.1, 0) AS INT) AS "right" FROM (
  SELECT p_partkey, r, (640 - round_even(h * r, 0)) / 2 AS dh, (640 - round_even(w * r, 0)) / 2 AS dw FROM (SELECT p_partkey, w, h, least(640 / h, 640 / w) AS r FROM (SELECT p_partkey, p_size * 10 + 1 AS w, p_partkey % 700 + 3 AS h FROM part)))""",
    "polygons": f"""WITH {BOXES} SELECT image, inst, round(least(greatest(x0 - 5, 0), 80) / 80, 6) AS x0, round(least(greatest(y0, 0), 50) / 50, 6) AS y0, round(least(greatest(x1 - 5, 0), 80) / 80, 6) AS x1,
  round(least(greatest(y0, 0), 50) / 50, 6) AS y1, round(least(greatest(x1 - 5, 0), 80) / 80, 6) AS x2, round(least(greatest(y1, 0), 50) / 50, 6) AS y2 FROM boxes""",
    "thinned_frames": """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE k % CAST(pow(2, greatest(ceil(log2(n / 3)), 0)) AS BIGINT) = 0""",
    "late_mean": """SELECT user_id, round(avg(value), 4) AS late FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE k >= n * 2 / 3 GROUP BY 1""",
    "camera_modes": """SELECT user_id, CASE WHEN m IS NULL OR (m < 15 AND p < 40) THEN 'static' ELSE 'moving' END AS mode FROM (SELECT user_id, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.9) AS p FROM (
  SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events) GROUP BY 1)""",
    "mask_scores": f"WITH {SCORES} SELECT image, round(leak, 4) AS leak, round(iou, 4) AS iou, round(cover, 4) AS cover, empty FROM scores",
    "leak_summary": f"""WITH {SCORES} SELECT count(*) AS n, round(avg(leak), 4) AS leak, round(avg(CAST(leak > 0.05 AS INT)), 4) AS over5, round(avg(CAST(leak > 0.15 AS INT)), 4) AS over15, count(*) FILTER (empty) AS empties FROM scores""",
    "mask_difference": f"""WITH {CELLS}, c AS (SELECT image, x * 13 + y AS cell, bool_or(o) AS cut FROM cells GROUP BY 1, 2)
SELECT image, count(*) AS n, CAST(sum(cell) AS BIGINT) AS sum FROM (SELECT *, count(*) FILTER (NOT cut) OVER (PARTITION BY image) < 0.5 * count(*) OVER (PARTITION BY image) AS spared FROM c) WHERE spared OR NOT cut GROUP BY 1""",
    "centres": f"WITH {CELLS} SELECT image, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM cells GROUP BY 1",
    "largest_parts": f"WITH {BOXES} SELECT image, inst, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {AREA} DESC, inst) AS place FROM boxes WHERE {AREA} >= 0.05 * 14400) WHERE place <= 2",
    "group_probability": f"WITH {BOXES} SELECT image, round(coalesce(sum(exp(conf)) FILTER (label = 'R'), 0) / sum(exp(conf)), 6) AS probability FROM boxes GROUP BY 1",
    "picture_errors": f"""WITH {BOXES} SELECT label, round(avg(abs(x1 - y1 * 2)), 4) AS l1, round(CASE WHEN avg((x1 - y1 * 2) ^ 2) = 0 THEN 99 ELSE 10 * log10(65025 / avg((x1 - y1 * 2) ^ 2)) END, 4) AS psnr,
  round(sum(least(x1, y1 * 2) / 255) / greatest(sum(greatest(x1, y1 * 2) / 255), 1e-6), 4) AS soft_iou FROM boxes GROUP BY 1""",
    "steady_values": """SELECT user_id, count(v) AS n, CASE WHEN count(v) >= 3 THEN round(quantile_cont(v, 0.5), 4) END AS median, round(avg(v), 4) AS plate FROM (SELECT user_id, CASE WHEN value > 10 THEN value END AS v FROM events) GROUP BY 1""",
    "boundary_f": f"""WITH {CELLS}, s AS (SELECT DISTINCT 'p' AS side, image % 400 AS g, x, y FROM cells WHERE m UNION SELECT 't', image % 400, x, y FROM cells WHERE t OR o),
e AS (SELECT * FROM s WHERE (SELECT count(*) FROM s n WHERE n.side = s.side AND n.g = s.g AND n.x BETWEEN s.x - 1 AND s.x + 1 AND n.y BETWEEN s.y - 1 AND s.y + 1)
  < (least(x + 1, 16) - greatest(x - 1, 0) + 1) * (least(y + 1, 12) - greatest(y - 1, 0) + 1)),
k AS (SELECT g, side, EXISTS (SELECT 1 FROM e n WHERE n.side <> e.side AND n.g = e.g AND CASE abs(n.y - e.y) WHEN 0 THEN abs(n.x - e.x) <= 2 WHEN 1 THEN abs(n.x - e.x) <= 2 WHEN 2 THEN n.x = e.x ELSE false END) AS near FROM e),
v AS (SELECT g, avg(CAST(near AS INT)) FILTER (side = 'p') AS p, avg(CAST(near AS INT)) FILTER (side = 't') AS r FROM k GROUP BY 1)
SELECT s.g AS image, round(coalesce(2 * p * r / greatest(p + r, 1e-9), 0), 6) AS f FROM (SELECT DISTINCT g FROM s) s LEFT JOIN v ON v.g = s.g""",
    "peer_ratio": f"WITH {BOXES} SELECT image, CASE WHEN count(*) >= 3 THEN round(max({AREA}) / quantile_cont({AREA}, 0.5), 4) END AS ratio FROM boxes GROUP BY 1",
    "paired_means": f"WITH {BOXES} SELECT count(*) AS n, round(avg(x1), 4) AS mean_a, round(avg(y1), 4) AS mean_b, true AS ordered FROM boxes",
    "every_position": f"WITH {BOXES}, f AS (SELECT *, {FRONT} AS front FROM boxes) " + " UNION ALL ".join(
        f"SELECT image, '{p}' AS position, inst FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round({x}, 6), inst) AS place FROM f) WHERE place = 1" for p, x in POSITION_SQL.items()),
    "ordinal_cases": f"""WITH {BOXES} SELECT image, inst, CASE place WHEN 1 THEN 'left' ELSE 'rank2' END AS scenario FROM (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY image) AS n
  FROM boxes WHERE {AREA} >= 0.025 * 14400 WINDOW w AS (PARTITION BY image ORDER BY x0 + x1, inst)) WHERE n >= 2 AND place <= 2""",
    "selection_table": f"""WITH {BOXES}, r AS (SELECT *, x0 + 1 AS v, lag(x0 + 1) OVER w AS b, lead(x0 + 1) OVER w AS c FROM boxes WINDOW w AS (PARTITION BY image ORDER BY x0 + 1, inst)),
u AS (SELECT *, coalesce(abs(v - b) < 0.03 OR abs(v - b) / greatest(v, b, 1e-9) < 0.1, false) OR coalesce(abs(v - c) < 0.03 OR abs(v - c) / greatest(v, c, 1e-9) < 0.1, false) AS unsure FROM r)
SELECT CASE WHEN unsure THEN 'ambiguous' ELSE 'clear' END AS kind, count(*) FILTER (conf > 0.5) AS ok, count(*) FILTER (conf > 0.2 AND conf <= 0.5) AS "order", count(*) FILTER (conf <= 0.2) AS miss FROM u GROUP BY 1""",
}
