"""Picking instances of a group by position, size and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salient(df: DataFrame, group: str, area: Column, share: float = 0.2, least_area: float | None = None) -> DataFrame:
    """Instances of at least ``share`` of the group's largest area, or of ``least_area``; the largest always passes."""
    top = F.max(area).over(Window.partitionBy(group))
    test = area >= share * top
    return df.withColumn("_keep", test if least_area is None else test | (area >= least_area)).where("_keep").drop("_keep")


def ordered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``place`` within the group, from 1, and the group's size ``n``."""
    w = Window.partitionBy(group)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))


def slice_of(df: DataFrame, rank: int | None = None, count: int | None = None) -> DataFrame:
    """``count`` instances from ``rank`` on, all if there is no count; a rank past the end takes the last one."""
    start = F.least(F.lit(rank or 1).cast("long"), F.col("n"))
    test = F.col("place") >= start
    return df.where(test if count is None else test & (F.col("place") < start + count))


def front_score(bottom: Column, height: Column, area: Column, group: str) -> Column:
    """Nearness to the viewer: 0.6 of how low an instance reaches, 0.4 of its area against the group's largest."""
    top = F.max(area).over(Window.partitionBy(group))
    return 0.6 * bottom / F.greatest(height - 1, F.lit(1)) + 0.4 * area / F.when(top == 0, 1).otherwise(top)


def with_position_keys(boxes: DataFrame, group: str, width: float, height: float) -> DataFrame:
    """``boxes`` with ``by_left, by_right, by_center, by_largest, by_smallest, by_front, by_back``: sort keys, the first in each order being the least."""
    cx, cy, area = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    front = front_score(F.col("y1"), F.lit(height), area, group)
    keys = {"left": cx, "right": -cx, "center": F.abs(cx - width / 2) + F.abs(cy - height / 2), "largest": -area, "smallest": area, "front": -front, "back": front}
    return boxes.withColumns({f"by_{name}": F.round(key, 6) for name, key in keys.items()})


def ambiguous(df: DataFrame, group: str, value: Column, key: str, relative: float, absolute: float = 0.0) -> DataFrame:
    """``df`` with ``unsure``: a neighbour in the order of ``value`` is within the ``absolute`` or the ``relative`` difference."""
    w = Window.partitionBy(group).orderBy(value, key)
    near = [(F.abs(value - other) < absolute) | (F.abs(value - other) / F.greatest(value, other, F.lit(1e-9)) < relative) for other in (F.lag(value).over(w), F.lead(value).over(w))]
    return df.withColumn("unsure", F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False)))
