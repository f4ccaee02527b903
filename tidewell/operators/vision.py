"""Boxes, cells and frames as rows: overlaps, matches, cut-offs, summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Area shares, attribute cut-offs, frames kept, and thresholds of frame differences.
LARGE, TINY = 0.025, 0.003
LEAST_SHARE, RELATIVE_SHARE = 0.06, 0.5
KEPT_FRAMES = 9


def intersection(a: str, b: str) -> Column:
    """Area that two boxes share; a box is ``x0, y0, x1, y1`` after its prefix."""
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def box_area(p: str) -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes; 1 if both are empty."""
    union = box_area(a) + box_area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(1.0)


def area_ratio(area: Column, width: Column, height: Column) -> Column:
    """Share of an image, 0 for an image without area."""
    return F.when(width * height > 0, area / (width * height)).otherwise(0.0)


def padded_box(df: DataFrame, share: float, width: int, height: int) -> DataFrame:
    """``df`` with its box widened by ``share`` of its sides and clamped to the image: ``px0, py0, px1, py1``."""
    dx, dy = (F.col("x1") - F.col("x0")) * share, (F.col("y1") - F.col("y0")) * share
    clamp = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(top)))
    return df.withColumns({"px0": clamp(F.col("x0") - dx, width), "py0": clamp(F.col("y0") - dy, height), "px1": clamp(F.col("x1") + dx, width), "py1": clamp(F.col("y1") + dy, height)})


def letterbox(width: Column, height: Column, size: int) -> Column:
    """How an image fits a square: ``scale, top, left, bottom, right``, halves to even."""
    r = F.least(size / height, size / width)
    high, wide = (size - F.bround(height * r)) / 2, (size - F.bround(width * r)) / 2
    edge = lambda x: F.bround(x).cast("int")
    return F.struct(r.alias("scale"), edge(high - 0.1).alias("top"), edge(wide - 0.1).alias("left"), edge(high + 0.1).alias("bottom"), edge(wide + 0.1).alias("right"))


def normal_polygon(points: Column, width: float, height: float) -> Column:
    """Points ``x, y`` clamped to the image and scaled to 0..1, six decimals; null under three points."""
    unit = lambda v, top: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(top)) / top, 6)
    return F.when(F.size(points) >= 3, F.transform(points, lambda p: F.struct(unit(p["x"], width).alias("x"), unit(p["y"], height).alias("y"))))


def side_by_side(left: DataFrame, right: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Every pair of a left and a right box of one image: an equi-join on the image, whose boxes are few by nature."""
    box = ["x0", "y0", "x1", "y1"]
    a = left.select(group, *(F.col(c).alias(f"a_{c}") for c in [*keys, *box]))
    b = right.select(group, *(F.col(c).alias(f"b_{c}") for c in [*keys, *box]))
    return a.join(b, group)


def best_overlap(preds: DataFrame, truths: DataFrame, group: str, key: str, least: float = 0.5) -> DataFrame:
    """``group, key, best, found`` of each truth: the largest overlap with a prediction, and whether it reaches ``least``."""
    pairs = side_by_side(truths, preds, group, [key]).groupBy(group, F.col(f"a_{key}").alias(key)).agg(F.max(iou("a_", "b_")).alias("best"))
    return truths.select(group, key).distinct().join(pairs, [group, key], "left").withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("found", F.col("best") >= least)


def unmatched(preds: DataFrame, truths: DataFrame, group: str, key: str, least: float = 0.5) -> DataFrame:
    """Predictions that overlap no truth by ``least`` or more: false positives."""
    hit = side_by_side(preds, truths, group, [key]).where(iou("a_", "b_") >= least).select(group, F.col(f"a_{key}").alias(key)).distinct()
    return preds.join(hit, [group, key], "left_anti")


def matched(pairs: DataFrame, group: str, left: str, right: str, score: str, in_row_order: bool) -> DataFrame:
    """One-to-one matches of the scored ``pairs`` of each group.

    ``in_row_order``: each left row in turn takes its best free partner, of ties the first. Otherwise the best-scored
    pair of all is taken first, of ties the one with the larger ids. Pairs are dealt by group, sorted, and stream through.
    """
    order = [F.col(group), F.col(left), F.desc(score), F.col(right)] if in_row_order else [F.col(group), F.desc(score), F.desc(left), F.desc(right)]
    rows = pairs.select(group, left, right, score).where(F.col(score) > 0).repartition(group).sortWithinPartitions(*order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used_l, used_r = None, set(), set()
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for k, (g, a, b) in enumerate(zip(frame[group], frame[left], frame[right], strict=True)):
                if g != now:
                    now, used_l, used_r = g, set(), set()
                if a not in used_l and b not in used_r:
                    used_l.add(a)
                    used_r.add(b)
                    keep[k] = True
            yield frame[keep]

    return rows.mapInPandas(run, rows.schema)


def hard_images(boxes: DataFrame, group: str, width: float, height: float) -> DataFrame:
    """Images in which two large boxes touch or overlap once widened by 0.02 of the longer side."""
    pad = 0.02 * max(width, height)
    big = boxes.where(box_area("") >= LARGE * width * height)
    near = (F.col("a_x0") - pad < F.col("b_x1")) & (F.col("b_x0") - pad < F.col("a_x1")) & (F.col("a_y0") - pad < F.col("b_y1")) & (F.col("b_y0") - pad < F.col("a_y1"))
    return side_by_side(big, big, group, ["inst"]).where("a_inst < b_inst").where(near).select(group).distinct()


def size_kinds(boxes: DataFrame, group: str, area: Column, image_area: float) -> DataFrame:
    """Boxes of at least the tiny share, in images that hold a large one; with ``large``."""
    rows = boxes.withColumn("large", area / image_area >= LARGE).where(area / image_area >= TINY)
    return rows.withColumn("_any", F.max("large").over(Window.partitionBy(group))).where("_any").drop("_any")


def attribute_cut(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Instances that reach the larger of a fixed share and half the best score; the best alone if none does."""
    w = Window.partitionBy(group)
    best = F.max(score).over(w)
    rows = df.withColumn("_pass", F.coalesce(F.col(score) >= F.greatest(F.lit(LEAST_SHARE), RELATIVE_SHARE * best), F.lit(False)))
    rows = rows.withColumn("_any", F.max("_pass").over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), key)))
    return rows.where(F.when(F.col("_any"), F.col("_pass")).otherwise(F.col("_place") == 1)).drop("_pass", "_any", "_place")


def best_first(df: DataFrame, group: str, score: str, key: str, most: int) -> DataFrame:
    """The ``most`` best-scored rows of a group: candidates before suppression, or results after it."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("place") <= most)


def thinned(frames: DataFrame, clip: str, order: str, most: int = KEPT_FRAMES) -> DataFrame:
    """Evenly spaced frames: every 2^k-th from the first, k the least that leaves at most ``most``."""
    w = Window.partitionBy(clip)
    rows = frames.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    stride = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("_n") / most)), F.lit(0))).cast("long")
    return rows.where(F.col("_at") % stride == 0).drop("_at", "_n")


def last_third(frames: DataFrame, clip: str, order: str, value: Column) -> DataFrame:
    """``clip, late``: mean of ``value`` over the frames from two thirds of the clip on."""
    w = Window.partitionBy(clip)
    rows = frames.select(clip, value.alias("_v"), (F.row_number().over(w.orderBy(order)) - 1).alias("_at"), F.count("*").over(w).alias("_n"))
    return rows.where(F.col("_at") >= F.col("_n") * 2 / 3).groupBy(clip).agg(F.avg("_v").alias("late"))


def frame_changes(frames: DataFrame, clip: str, order: list[str], value: Column) -> DataFrame:
    """``frames`` with ``change``: the absolute difference to the frame before."""
    return frames.withColumn("change", F.abs(value - F.lag(value).over(Window.partitionBy(clip).orderBy(*order))))


def camera_mode(changes: DataFrame, clip: str, median: float, p90: float) -> DataFrame:
    """``clip, mode``: static if the median and the 90th percentile of changes are low, or there is none; else moving."""
    parts = changes.groupBy(clip).agg(F.percentile("change", F.lit(0.5)).alias("m"), F.percentile("change", F.lit(0.9)).alias("p"))
    return parts.select(clip, F.when(F.col("m").isNull() | ((F.col("m") < median) & (F.col("p") < p90)), "static").otherwise("moving").alias("mode"))


def mask_scores(cells: DataFrame, group: str) -> DataFrame:
    """``group, leak, iou, cover, empty`` from cells with booleans ``mask, target, others``: one pass of counts."""
    n = lambda c: F.count_if(c)
    m, t, o = F.col("mask"), F.col("target"), F.col("others")
    share = lambda a, b: F.when(n(m) == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))
    return cells.groupBy(group).agg(share(n(m & o), n(m)).alias("leak"), share(n(m & t), n(m | t)).alias("iou"), share(n(m & t), n(t)).alias("cover"), (n(m) == 0).alias("empty"))


def leak_summary(scores: DataFrame) -> DataFrame:
    """One row: cases, mean leak, shares of cases over 5 and 15 percent, empty masks."""
    over = lambda x: F.avg((F.col("leak") > x).cast("double"))
    return scores.agg(F.count("*").alias("n"), F.avg("leak").alias("leak"), over(0.05).alias("over5"), over(0.15).alias("over15"), F.count_if("empty").alias("empties"))


def subtracted(cells: DataFrame, cut: DataFrame, group: str, cell: str, least: float = 0.5) -> DataFrame:
    """Cells without those of ``cut``, unless a group would keep less than ``least`` of its cells: then as they were."""
    marked = cells.select(group, cell).distinct().join(cut.select(group, cell).distinct().withColumn("_cut", F.lit(True)), [group, cell], "left")
    w = Window.partitionBy(group)
    spared = F.count_if(F.col("_cut").isNull()).over(w) < least * F.count("*").over(w)
    return marked.withColumn("_spared", spared).where(F.col("_spared") | F.col("_cut").isNull()).select(group, cell)


def centre_and_box(cells: DataFrame, group: str) -> DataFrame:
    """Centroid and bounding box of each group's cells (x, y)."""
    return cells.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def largest_parts(parts: DataFrame, group: str, area: str, key: str, image_area: float, most: int = 24, share: float = TINY) -> DataFrame:
    """The ``most`` largest parts of at least ``share`` of the image."""
    return best_first(parts.where(F.col(area) >= share * image_area), group, area, key, most)


def group_probability(logits: DataFrame, group: str, logit: str, member: Column) -> DataFrame:
    """``group, probability``: the softmax mass of the members; the largest logit is taken off first."""
    e = F.exp(F.col(logit) - F.max(logit).over(Window.partitionBy(group)))
    rows = logits.select(group, e.alias("_e"), member.alias("_in"))
    return rows.groupBy(group).agg((F.sum(F.when(F.col("_in"), F.col("_e")).otherwise(0.0)) / F.sum("_e")).alias("probability"))


def picture_errors(pixels: DataFrame, group: str, a: Column, b: Column) -> DataFrame:
    """``group, l1, psnr, soft_iou`` of values from 0 to 255; 99 where they are equal."""
    mse = F.avg((a - b) * (a - b))
    soft = F.sum(F.least(a, b) / 255) / F.greatest(F.sum(F.greatest(a, b) / 255), F.lit(1e-6))
    return pixels.groupBy(group).agg(F.avg(F.abs(a - b)).alias("l1"), F.when(mse == 0, 99.0).otherwise(10 * F.log10(255.0 * 255 / mse)).alias("psnr"), soft.alias("soft_iou"))


def edge_cells(cells: DataFrame, group: str, width: int, height: int) -> DataFrame:
    """Cells (x, y) of a group's set with a neighbour, of eight, in the image but not in the set."""
    own = cells.select(group, "x", "y").distinct()
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = own.withColumn("_i", step).withColumn("_j", step).select(group, (F.col("x") + F.col("_i")).alias("x"), (F.col("y") + F.col("_j")).alias("y"))
    span = lambda c, top: F.least(F.col(c) + 1, F.lit(top - 1)) - F.greatest(F.col(c) - 1, F.lit(0)) + 1
    counts = near.groupBy(group, "x", "y").agg(F.count("*").alias("_n"))
    return own.join(counts, [group, "x", "y"]).where(F.col("_n") < span("x", width) * span("y", height)).select(group, "x", "y")


def near_share(cells: DataFrame, others: DataFrame, group: str, reach: int) -> DataFrame:
    """``group, n, near``: cells, and how many of them lie within an ellipse of ``reach`` around one of ``others``."""
    half = F.bround(reach * F.sqrt(1 - F.pow(F.col("_j") / reach, F.lit(2)))).cast("int")
    disc = others.withColumn("_j", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_i", F.explode(F.sequence(-half, half)))
    disc = disc.select(group, (F.col("x") + F.col("_i")).alias("x"), (F.col("y") + F.col("_j")).alias("y")).distinct().withColumn("_in", F.lit(1))
    return cells.join(disc, [group, "x", "y"], "left").groupBy(group).agg(F.count("*").alias("n"), F.count("_in").alias("near"))


def boundary_f(preds: DataFrame, truths: DataFrame, group: str, width: int, height: int) -> DataFrame:
    """``group, f``: harmonic mean of the shares of either boundary that lies near the other; 0 where one is missing.

    Near: within 0.004 of the image's diagonal, at least 2 cells. Cells of an image are joined by image and place.
    """
    reach = max(2, round(0.004 * (width * width + height * height) ** 0.5))
    a, b = edge_cells(preds, group, width, height), edge_cells(truths, group, width, height)
    share = lambda x, y, name: near_share(x, y, group, reach).select(group, (F.col("near") / F.col("n")).alias(name))
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    groups = preds.select(group).unionByName(truths.select(group)).distinct()
    both = groups.join(share(a, b, "precision"), group, "left").join(share(b, a, "recall"), group, "left")
    return both.select(group, (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f"))


def steady_median(frames: DataFrame, by: str, value: Column, seen: Column, least: int = 3) -> DataFrame:
    """``by, n, median, plate``: of the values seen, the median where there are ``least`` or more, and the mean."""
    v = F.when(seen, value)
    return frames.groupBy(by).agg(F.count(v).alias("n"), F.when(F.count(v) >= least, F.percentile(v, F.lit(0.5))).alias("median"), F.avg(v).alias("plate"))


def peer_ratio(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """``group, ratio``: largest value over the median, where there are ``least`` peers."""
    return df.groupBy(group).agg(F.when(F.count(value) >= least, F.max(value) / F.percentile(value, F.lit(0.5))).alias("ratio"))


#: Rows whose weights a task makes at a time.
BOOTSTRAP_ROWS = 1024
#: Numbers of 32 bits up to which a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON_STEPS = (np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(13)]) * 2**32).astype(np.uint64).astype(np.uint32)


def poisson_weights(seeds: np.ndarray, resamples: int) -> np.ndarray:
    """Rows by resamples: a Poisson number of mean 1 each, from a mixed hash of the row's seed and the resample's number."""
    half = (resamples + 1) // 2
    x = seeds[:, None] + np.arange(1, half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = x.view(np.uint32).reshape(len(seeds), 2 * half)[:, :resamples]
    out = np.zeros(bits.shape, np.int8)
    for step in POISSON_STEPS:
        above = bits >= step
        if not above.any():
            break
        out += above
    return out


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, resamples: int = 2000) -> DataFrame:
    """One row: ``n, mean_a, mean_b`` and ``low, high``, the 95 percent interval of the mean difference.

    Every row has a Poisson weight of its own in each resample, from a hash of its key and the resample's number, so tasks give partial sums and no row is
    gathered anywhere. Rows with a null are left out.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.xxhash64(key).alias("seed"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for frame in frames:
            seeds, d = frame["seed"].to_numpy().astype(np.uint64), (frame["b"] - frame["a"]).to_numpy()
            for at in range(0, len(d), BOOTSTRAP_ROWS):
                w = poisson_weights(seeds[at : at + BOOTSTRAP_ROWS], resamples)
                weight += w.sum(axis=0, dtype=np.int64)
                total += d[at : at + BOOTSTRAP_ROWS] @ w.astype(np.float64)
        yield pd.DataFrame({"resample": np.arange(resamples), "weight": weight, "total": total})

    sums = rows.mapInPandas(run, "resample int, weight double, total double").groupBy("resample").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    means = sums.where("weight > 0").agg(F.percentile(F.col("total") / F.col("weight"), F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return rows.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")).crossJoin(F.broadcast(means)).select("n", "mean_a", "mean_b", F.get("ci", F.lit(0)).alias("low"), F.get("ci", F.lit(1)).alias("high"))
