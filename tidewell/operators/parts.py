"""Masks as cells of a grid: connected parts, exclusive ownership, and suppression of overlapping boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.vision import best_first
from tidewell.sources.tables import settled

#: A cell's number is its row times this plus its column, so numbers follow reading order.
ROW = 1 << 31
#: Sides of a tile, within which cells are labelled by one task at a time.
TILE = 256
#: Links of one group that a task holds at once.
MOST_LINKS = 2_000_000
# The share of a mask that must be left, and that an island must have; the overlap and caps of suppression.
LEAST_LEFT, LEAST_ISLAND = 0.5, 0.04
MOST_OVERLAP, MOST_BEFORE, MOST_AFTER = 0.7, 1000, 300


def cell_number(x: Column, y: Column) -> Column:
    return y.cast("long") * ROW + x


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers below ``n`` that each reaches by links from ``a`` to ``b``."""
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label = label[label]
    return label


def run_labels(tile: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first cell of each cell's part, as a number; cells come ordered by tile, row and column, and tiles don't touch each other.

    Cells of a row that follow each other are a run; runs of neighbouring rows that touch, also by corners, are united, all tiles at a time.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    head = np.concatenate([[True], (np.diff(tile) != 0) | (np.diff(y) != 0) | (np.diff(x) != 1)])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(x)]]) - 1
    wide, high = int(x.max() - x.min()) + 4, int(y.max() - y.min()) + 2
    _, dense = np.unique(tile[first], return_inverse=True)
    row = dense.astype(np.int64) * high + (y[first] - y.min())
    left, right = x[first] - x.min() + 1, x[last] - x.min() + 1
    # Runs of the next row that reach into the columns from one before to one after.
    low = np.searchsorted(row * wide + right, (row + 1) * wide + left - 1)
    count = np.maximum(np.searchsorted(row * wide + left, (row + 1) * wide + right + 1, "right") - low, 0)
    a = np.repeat(np.arange(len(first)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    root = first[united(len(first), a, b)]
    return np.repeat(y[root].astype(np.int64) * ROW + x[root], last - first + 1)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Numbers rows by runs of equal values in all columns."""
    codes = [np.asarray(c.dictionary_encode(null_encoding="encode").indices) for c in columns]
    return np.cumsum(np.concatenate([[0], np.any([c[1:] != c[:-1] for c in codes], axis=0)])) if len(columns[0]) else np.zeros(0, int)


def tile_parts(cells: DataFrame, group: list[str], tile: int, distinct: bool = False) -> DataFrame:
    """``group, x, y, part``: parts within each tile. Tiles stream through sorted partitions; a task holds the last, unfinished one. ``distinct``: cells don't repeat."""
    at = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "xy"]
    names = [f"g{i}" for i in range(len(group))]
    rows = cells.select(*(F.col(c).alias(n) for c, n in zip(group, names, strict=True)), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    rows = (rows if distinct else rows.distinct()).select(*names, "x", "y", *at)
    rows = rows.withColumn("tile", F.xxhash64(*names, "tx", "ty"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled(rows: pa.Table) -> pa.RecordBatch:
            own = [rows.column(c).combine_chunks() for c in (*names, "tx", "ty")]
            y, x = (rows.column(c).to_numpy() for c in "yx")
            return pa.RecordBatch.from_arrays([*own[:-2], pa.array(x), pa.array(y), pa.array(run_labels(changes(own), y, x))], [*names, "x", "y", "part"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            mark = held.column("tile").to_numpy()
            done = int(np.searchsorted(mark, mark[-1])) if len(mark) else 0
            if done:
                yield labelled(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield labelled(held)

    # Tiles with one hash keep to themselves by the columns behind it.
    placed = rows.repartition("tile").sortWithinPartitions("tile", *names, "tx", "ty", "y", "x")
    return placed.mapInArrow(run, f"{kinds}, x long, y long, part long").withColumnsRenamed(dict(zip(names, group, strict=True)))


def near_linked(edges: DataFrame, group: list[str], most: int = MOST_LINKS) -> DataFrame:
    """``group, a, b, ended``: links from each number to the least it reaches among links that a task holds at once.

    Groups stream through sorted partitions. ``ended``: all of the group was held, so ``b`` is the least at all; a group of more than ``most`` links is
    worked on in portions, whose links still join what was joined.
    """
    kinds = ", ".join(f"{g} {edges.schema[g].dataType.simpleString()}" for g in group)

    def solved(rows: pa.Table, ended: bool) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        code = np.tile(changes([rows.column(g).combine_chunks() for g in group]), 2)
        number = np.concatenate([rows.column(c).to_numpy() for c in "ab"])
        order = np.lexsort((number, code))
        head = np.concatenate([[True], (np.diff(code[order]) != 0) | (np.diff(number[order]) != 0)])
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(head) - 1
        first, n = order[head], rows.num_rows
        label = united(len(first), node[:n], node[n:])
        far = np.flatnonzero(label != np.arange(len(first)))
        own = rows.select(group).take(pa.array(first[far] % n)).combine_chunks()
        arrays = [*(own.column(g).combine_chunks() for g in group), pa.array(number[first[far]]), pa.array(number[first[label[far]]]), pa.array(np.full(len(far), ended))]
        return pa.RecordBatch.from_arrays(arrays, [*group, "a", "b", "ended"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            code = changes([held.column(g).combine_chunks() for g in group])
            first, last = int(np.searchsorted(code, 1)), int(np.searchsorted(code, code[-1]))
            if cut and last:
                yield solved(held.slice(0, first), False)
                held, last, cut = held.slice(first), last - first, False
            if last:
                yield solved(held.slice(0, last), True)
                held = held.slice(last)
            if held.num_rows > most:
                yield solved(held, False)
                held, cut = held.slice(held.num_rows), True
        if held is not None and held.num_rows:
            yield solved(held, not cut)

    return edges.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, f"{kinds}, a long, b long, ended boolean")


def least_linked(edges: DataFrame, group: list[str], most: int = MOST_LINKS) -> DataFrame:
    """``group, a, least``: the least number that each linked number reaches; groups that a task can't hold at once go on by rounds of large and small stars."""
    near = settled(near_linked(edges, group, most))
    done, left = (near.where(test).select(*group, "a", "b") for test in ("ended", "not ended"))
    if left.isEmpty():
        return done.withColumnRenamed("b", "least")
    links, before = settled(left.select(*group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = links.unionByName(links.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*group, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, [*group, "a"]).select(*group, F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy(*group, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*group, "a"]).where("b > m").select(*group, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        links = settled(small.distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64(*group, "a", "b"))).first()
        if now == before:
            return done.unionByName(links).withColumnRenamed("b", "least")
        before = now


def linked_tiles(rows: DataFrame, group: list[str], tile: int) -> DataFrame:
    """``group, part, least``: for parts of tiles that touch parts of other tiles, the first cell of all that they reach."""
    rim = rows.where(" or ".join(f"{c} % {tile} in (0, {tile - 1})" for c in "xy"))
    steps = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))))).alias("to")
    near = rim.select(*group, "x", "y", F.col("part").alias("b"), steps)
    # Only steps that leave the tile can link two of its parts' labels.
    near = near.where(" or ".join(f"floor({c} / {tile}) <> floor(to.{c} / {tile})" for c in "xy")).select(*group, "b", "to.x", "to.y")
    edges = rim.select(*group, "x", "y", F.col("part").alias("a")).join(near, [*group, "x", "y"]).where("a <> b").select(*group, "a", "b")
    return least_linked(edges, group).withColumnRenamed("a", "part")


def connected_parts(cells: DataFrame, group: str, tile: int = TILE) -> DataFrame:
    """``group, x, y, part``: cells (x, y, not negative) that touch by sides or corners are of one part, named by its first cell in reading order.

    Tiles of ``tile`` by ``tile`` cells are labelled apart, so one huge image is spread over tasks; then cells along the tiles' edges
    link the labels of neighbours, and only those links are brought together. Repeated cells count once.
    """
    rows = settled(tile_parts(cells, [group], tile))
    return rows.join(linked_tiles(rows, [group], tile), [group, "part"], "left").select(group, "x", "y", F.coalesce("least", "part").alias("part"))


def part_sizes(parts: DataFrame, group: str) -> DataFrame:
    """Per part its area and box."""
    return parts.groupBy(group, "part").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


#: Whether an instance takes cells it shares with the target, by its confidence and its lowest row.
OWNERS = {
    "subtract": lambda: F.lit(True),
    "conf": lambda: F.col("conf") > F.col("target_conf"),
    "front": lambda: (F.col("bottom") > F.col("target_bottom")) | ((F.col("bottom") == F.col("target_bottom")) & (F.col("conf") > F.col("target_conf"))),
}


def exclusive_mask(target: DataFrame, others: DataFrame, group: str, inst: str, mode: str, tile: int = TILE) -> DataFrame:
    """``group, x, y`` of ``exclusive_masks`` for one mode."""
    return exclusive_masks(target, others, group, inst, (mode,), tile).select(group, "x", "y")


def exclusive_masks(target: DataFrame, others: DataFrame, group: str, inst: str, modes: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """``group, mode, x, y``: for each of the modes (off, subtract, conf, front) the union of the target's cells without those of other instances that own them by it.

    Cells have an instance and its ``conf``. If less than half would be left, a group keeps its union; else parts of less than 0.04 of the union go,
    unless none would stay; ``off`` keeps the union. Cells are dealt once by group, for all modes, and parts are counted by tile before they are put together.
    """
    none = F.lit(None).cast(others.schema[inst].dataType)
    rows = target.select(group, "x", "y", F.lit(True).alias("aim"), none.alias("inst"), "conf").unionByName(others.select(group, "x", "y", F.lit(False).alias("aim"), F.col(inst).alias("inst"), "conf"))
    by, own = Window.partitionBy(group), Window.partitionBy(group, "aim", "inst")
    rows = rows.repartition(group).withColumns({
        "conf": F.max("conf").over(own), "bottom": F.max("y").over(own), "target_conf": F.max(F.when(F.col("aim"), F.col("conf"))).over(by), "target_bottom": F.max(F.when(F.col("aim"), F.col("y"))).over(by),
    })
    cutting = [m for m in modes if m != "off"]
    owns = lambda m: ~F.col("aim") & F.col("inst").isNotNull() & F.col(group).isNotNull() & OWNERS[m]()
    cells = rows.groupBy(group, "x", "y").agg(F.max("aim").alias("aim"), *(F.coalesce(F.max(owns(m)), F.lit(False)).alias(f"cut_{m}") for m in cutting)).where("aim").drop("aim")
    cells = cells.withColumns({"whole": F.count("*").over(by), **{f"left_{m}": F.count_if(~F.col(f"cut_{m}")).over(by) for m in cutting}})
    spared = lambda m: F.col(f"left_{m}") < LEAST_LEFT * F.col("whole")
    kinds = [F.struct(F.lit(m).alias("mode"), F.col(f"cut_{m}").alias("cut"), spared(m).alias("spared")) if m != "off" else F.struct(F.lit(m).alias("mode"), F.lit(False).alias("cut"), F.lit(True).alias("spared")) for m in modes]
    cells = settled(cells).select(group, "x", "y", "whole", F.explode(F.array(*kinds)).alias("m")).select(group, "m.mode", "whole", "x", "y", "m.cut", "m.spared")
    # A group's number of cells goes with its parts as if it were a part of the key.
    key = [group, "mode", "whole"]
    parts = settled(tile_parts(cells.where("not spared and not cut"), key, tile, True))
    sizes = parts.groupBy(*key, "part").agg(F.count("*").alias("n")).join(linked_tiles(parts, key, tile), [*key, "part"], "left").withColumn("root", F.coalesce("least", "part")).repartition(*key)
    large = F.sum("n").over(Window.partitionBy(*key, "root")) >= LEAST_ISLAND * F.col("whole")
    kept = sizes.withColumn("large", large).withColumn("any", F.max("large").over(Window.partitionBy(*key))).where("large or not any")
    stay = parts.join(kept.select(*key, "part"), [*key, "part"], "left_semi").select(group, "mode", "x", "y")
    return cells.where("spared").select(group, "mode", "x", "y").unionByName(stay)


def suppressed(boxes: DataFrame, image: str, label: str, score: str, key: str, overlap: float = MOST_OVERLAP, before: int = MOST_BEFORE, after: int = MOST_AFTER) -> DataFrame:
    """``boxes`` that stay when, best score first, each box overlapping a kept one of its label by more than ``overlap`` goes; with ``place``.

    An image's best ``before`` boxes are looked at and ``after`` stay at most; ties go to the least key. The first cap bounds what a task holds of an
    image. Images stream through the window's partitions; all that came with a batch are worked on at a time, place by place.
    """
    rows = best_first(boxes, image, score, key, before).sortWithinPartitions(image, "place")
    names, schema = ("x0", "y0", "x1", "y1"), rows.schema

    def chosen(table: pa.Table) -> list[pa.RecordBatch]:
        place = table.column("place").to_numpy()
        first = np.flatnonzero(place == 1)
        code = table.column(label).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        stays = kept_boxes(np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in names], axis=1), code, first, overlap)
        count = np.cumsum(stays)
        number = count - np.repeat(count[first] - stays[first], np.diff(np.append(first, len(place))))
        at = np.flatnonzero(stays & (number <= after))
        out = table.take(pa.array(at))
        return out.set_column(out.column_names.index("place"), "place", pa.array(number[at], pa.int32())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            # The last image may go on in the next batch.
            starts = np.flatnonzero(held.column("place").to_numpy() == 1)
            done = int(starts[-1]) if len(starts) else 0
            if done:
                yield from chosen(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield from chosen(held)

    return rows.mapInArrow(run, schema)


def kept_boxes(box: np.ndarray, label: np.ndarray, first: np.ndarray, overlap: float) -> np.ndarray:
    """Which boxes stay of images that begin at ``first``, their boxes best first: a box goes if a kept one before it with its label overlaps it by more than ``overlap``."""
    size = np.diff(np.append(first, len(box)))
    order = np.argsort(-size, kind="stable")
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    wide = int(size.max(initial=0))
    # Images by places, the longest images first, so those that reach a place are the first rows.
    at = first[order][:, None] + np.minimum(np.arange(wide), size[order][:, None] - 1)
    x0, y0, x1, y1 = (box[:, i][at] for i in range(4))
    kind, whole, keep = label[at], area[at], np.zeros(at.shape, bool)
    for i in range(wide):
        n = int(np.searchsorted(-size[order], -i, "left"))
        now, past = (slice(0, n), slice(i, i + 1)), (slice(0, n), slice(0, i))
        shared = np.maximum(np.minimum(x1[now], x1[past]) - np.maximum(x0[now], x0[past]), 0) * np.maximum(np.minimum(y1[now], y1[past]) - np.maximum(y0[now], y0[past]), 0)
        covers = keep[past] & (kind[now] == kind[past]) & (shared > overlap * (whole[now] + whole[past] - shared))
        keep[:n, i] = ~covers.any(axis=1)
    out = np.zeros(len(box), bool)
    out[at[keep]] = True
    return out
