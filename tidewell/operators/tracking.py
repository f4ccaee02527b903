"""Following chosen instances through the frames of a clip."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.state import deal, folded

# Fixed values of the rules.
LEAST_IOU, LOOK_SHARE, LEAST_LOOK = 0.15, 0.4, 0.35
REACH, LOST_LONG, LOST_FOR_GOOD = 3, 8, 24
SLOWING, TOP_SPEED, SIDE = 0.9, 0.08, 160
PARTLY, MERGED, MERGED_SHARE, MERGED_SIZE, DOUBLE = 0.7, 1.5, 0.2, 0.25, 0.6
NEWCOMER, SAME_LOOK = 0.15, 0.6
#: Columns of a track's row of numbers: box, speed, drift since it was last seen whole, usual size, frames unmatched, frames not seen whole, whether it is a target.
BOX, SPEED, DRIFT, SIZE, LOST, BLIND, TARGET = slice(0, 4), slice(4, 6), slice(6, 8), 8, 9, 10, 11
Chooser = Callable[[np.ndarray], np.ndarray]


def shares(values: Column) -> Column:
    """An array of counts as shares of their sum; null if that is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(values, lambda v: v / total))


def by_position(position: str, count: int) -> Chooser:
    """The rule that picks ``count`` boxes (x0, y0, x1, y1): from the left, from the right, or the largest."""

    def choose(box: np.ndarray) -> np.ndarray:
        centre, area = (box[:, 0] + box[:, 2]) / 2, sizes(box)
        return np.argsort({"left": centre, "right": -centre, "largest": -area}[position], kind="stable")[:count]

    return choose


def sizes(box: np.ndarray) -> np.ndarray:
    return (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that each box of ``a`` shares with each of ``b``."""
    side = np.minimum(a[:, None, 2:4], b[None, :, 2:4]) - np.maximum(a[:, None, 0:2], b[None, :, 0:2])
    return np.prod(np.maximum(side, 0), axis=2)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the Bhattacharyya distance of each pair of looks; NaN where a look is missing."""
    return 1 - np.sqrt(np.maximum(1 - np.sqrt(a[:, None, :] * b[None, :, :]).sum(axis=2), 0))


def paired(score: np.ndarray, allowed: np.ndarray) -> dict[int, int]:
    """Track to detection, best score first; ties go to the later track, then the later detection."""
    rows, cols = np.nonzero(allowed)
    out: dict[int, int] = {}
    taken: set[int] = set()
    order = np.lexsort((-cols, -rows, -score[rows, cols]))
    for t, d in zip(rows[order].tolist(), cols[order].tolist(), strict=True):
        if t not in out and d not in taken:
            out[t] = d
            taken.add(d)
    return out


def coast(row: list[float]) -> None:
    row[6] += row[4]
    row[7] += row[5]
    row[BLIND] += 1


def see(rows: list[list[float]], t: int, box: list[float]) -> bool:
    """A matched track moves on, or coasts if its box is a part of it or has run together with another's; whether it moved."""
    row, (x0, y0, x1, y1) = rows[t], box
    size = (x1 - x0) * (y1 - y0)
    merged = False
    if size > MERGED * max(row[SIZE], 1):
        for o, other in enumerate(rows):
            if o != t and other[SIZE] >= MERGED_SIZE * size:
                dx, dy = other[6] + other[4], other[7] + other[5]
                shared = max(min(x1, other[2] + dx) - max(x0, other[0] + dx), 0) * max(min(y1, other[3] + dy) - max(y0, other[1] + dy), 0)
                merged = merged or shared > MERGED_SHARE * other[SIZE]
    row[LOST] = 0
    if size < PARTLY * row[SIZE] or merged:
        coast(row)
        return False
    speed = [(row[4 + i] + ((box[i] + box[i + 2]) - (row[i] + row[i + 2])) / 2 / (row[BLIND] + 1)) / 2 for i in (0, 1)]
    fastest, now = TOP_SPEED * SIDE, float(np.hypot(*speed))
    row[4:6] = speed if now <= fastest else [v * fastest / now for v in speed]
    row[BOX], row[DRIFT], row[BLIND] = box, [0.0, 0.0], 0
    row[SIZE] = 0.7 * row[SIZE] + 0.3 * size if row[SIZE] else size
    return True


class Clip:
    """The tracks of a clip: a row of numbers and a look each."""

    def __init__(self, choose: Chooser) -> None:
        self.choose, self.rows, self.looks = choose, np.zeros((0, 12)), np.zeros((0, 0))

    def ahead(self) -> np.ndarray:
        """Boxes where the tracks are expected."""
        return self.rows[:, BOX] + np.tile(self.rows[:, DRIFT] + self.rows[:, SPEED], 2)

    def targets(self) -> np.ndarray:
        return np.flatnonzero(self.rows[:, TARGET])

    def add(self, box: np.ndarray, look: np.ndarray, target: bool) -> None:
        row = np.zeros((1, 12))
        row[0, BOX], row[0, SIZE], row[0, TARGET] = box, sizes(box[None])[0], target
        self.rows = np.concatenate([self.rows, row])
        self.looks = np.concatenate([self.looks.reshape(len(self.rows) - 1, -1) if len(self.rows) > 1 else np.zeros((0, len(look))), look[None]])

    def double(self, box: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Which boxes are second detections of a chosen one."""
        least = np.minimum(sizes(box)[:, None], sizes(chosen)[None, :])
        return (overlaps(box, chosen) > DOUBLE * np.maximum(least, 1)).any(axis=1)

    def start(self, box: np.ndarray, look: np.ndarray) -> list[int]:
        """Choose anew; all others are followed too, so that they aren't taken for a target."""
        chosen = self.choose(box)
        self.rows, self.looks = np.zeros((0, 12)), np.zeros((0, look.shape[1]))
        double = self.double(box, box[chosen])
        for d in range(len(box)):
            if d in chosen or not double[d]:
                self.add(box[d], look[d], d in chosen)
        return sorted(chosen.tolist())

    def miss_all(self) -> None:
        rows = self.rows
        rows[:, LOST] += 1
        rows[:, DRIFT] += rows[:, SPEED]
        rows[:, BLIND] += 1
        rows[:, SPEED] *= SLOWING

    def move(self, found: dict[int, int], box: np.ndarray, look: np.ndarray) -> None:
        """Every track in turn: matched ones see their box, the others miss. Few numbers at a time, so on plain lists."""
        rows, boxes, known = self.rows.tolist(), box.tolist(), (~np.isnan(look).any(axis=1)).tolist()
        for t, row in enumerate(rows):
            if t not in found:
                row[LOST] += 1
                coast(row)
                row[4] *= SLOWING
                row[5] *= SLOWING
            elif see(rows, t, boxes[found[t]]) and known[found[t]]:
                self.looks[t] = look[found[t]]
        self.rows = np.array(rows).reshape(-1, 12)

    def take_up(self, t: int, box: np.ndarray) -> None:
        self.rows[t, BOX], self.rows[t, SIZE] = box, sizes(box[None])[0]
        self.rows[t, SPEED] = self.rows[t, DRIFT] = 0
        self.rows[t, LOST] = self.rows[t, BLIND] = 0

    def frame(self, box: np.ndarray, look: np.ndarray) -> tuple[list[int], str]:
        """The chosen detections of the next frame, and what happened: chosen, followed, lost, recognised or newcomer."""
        if not len(box):
            if len(self.rows):
                self.miss_all()
            return [], "lost" if len(self.targets()) else "empty"
        if not len(self.targets()):
            return self.start(box, look), "chosen"
        ahead, alike = self.ahead(), likeness(self.looks, look)
        close = np.nan_to_num(alike, nan=0.5)
        shared = overlaps(ahead, box)
        iou = shared / np.maximum(sizes(ahead)[:, None] + sizes(box)[None, :] - shared, 1)
        found = paired(iou * (1 - LOOK_SHARE) + close * LOOK_SHARE, (shared > 0) & (iou >= LEAST_IOU) & (close >= LEAST_LOOK))
        wide = ahead + np.array([-REACH, -REACH, REACH, REACH])
        for t in self.targets().tolist():
            if t in found:
                continue
            free = [d for d in range(len(box)) if d not in found.values() and overlaps(wide[t][None], box[d][None])[0, 0] > 0 and close[t, d] >= LEAST_LOOK]
            if free:
                found[t] = max(free, key=lambda d: (close[t, d], -d))
        self.move(found, box, look)
        targets, event = self.targets(), "followed"
        if any(t not in found for t in targets):
            event = "lost"
        if (self.rows[targets, LOST] > LOST_LONG).all():
            again, how = self.recovered(targets, box, alike, set(found.values()))
            if again is not None:
                found[int(targets[0])], event = again, how
            elif (self.rows[targets, LOST] > LOST_FOR_GOOD).all():
                return self.start(box, look), "chosen"
        chosen = [found[t] for t in targets.tolist() if t in found]
        rest = [d for d in range(len(box)) if d not in found.values()]
        double = self.double(box, box[chosen])
        for d in rest:
            if not double[d]:
                self.add(box[d], look[d], False)
        stay = (self.rows[:, TARGET] > 0) | (self.rows[:, LOST] <= LOST_LONG)
        self.rows, self.looks = self.rows[stay], self.looks[stay]
        return sorted(chosen), event

    def recovered(self, targets: np.ndarray, box: np.ndarray, alike: np.ndarray, used: set[int]) -> tuple[int | None, str]:
        """The detection with which a single target lost for long goes on: the one that looks like it, else what the rule picks of those new and large enough."""
        free = [d for d in range(len(box)) if d not in used]
        if len(targets) != 1 or not free:
            return None, ""
        t = int(targets[0])
        same = [d for d in free if alike[t, d] >= SAME_LOOK]
        if same:
            pick, how = max(same, key=lambda d: (alike[t, d], -d)), "recognised"
        else:
            fresh = [d for d in free if sizes(box[d][None])[0] >= NEWCOMER * self.rows[t, SIZE]]
            if not fresh:
                return None, ""
            pick, how = fresh[int(self.choose(box[fresh])[0])], "newcomer"
        self.take_up(t, box[pick])
        return pick, how


def tracked(detections: DataFrame, clip: str, frame: str, choose: Chooser, dealt: bool = False) -> DataFrame:
    """``clip, frame, chosen, event``: the detections (``det``) of each frame that go on with those that ``choose`` picked at first.

    ``detections`` has det (null: a frame without any), a box and ``look``, shares of a histogram (null: unknown). Boxes are in a picture of 160 units. A frame's
    detections are gathered in one row; a clip's frames stream through a fold in order, so a clip of any length takes the memory of its tracks. Rows are shuffled once, by
    clip; not at all if they are ``dealt`` by clip already.
    """
    detections = detections if dealt else deal(detections, clip)
    known = F.sort_array(F.collect_list(F.when(F.col("det").isNotNull(), F.struct("det", F.array("x0", "y0", "x1", "y1").alias("box"), F.coalesce("look", F.array().cast("array<double>")).alias("look")))))
    rows = detections.groupBy(clip, frame).agg(known.alias("d")).select(clip, frame, F.col("d.det").alias("det"), F.flatten("d.box").alias("box"), F.transform("d.look", F.size).alias("bins"), F.flatten("d.look").alias("look"))

    def step(state: Clip | None, values: tuple) -> tuple[Clip, tuple]:
        det, box, sizes, look = values
        state = state or Clip(choose)
        # Boxes and looks come as flat lists; a look without bins is unknown.
        bins = int(sizes.max(initial=0)) or max(state.looks.shape[1], 1)
        looks = np.full((len(det), bins), np.nan)
        looks[sizes > 0] = look.reshape(-1, bins)
        if len(state.rows) and state.looks.shape[1] != bins:
            state.looks = np.full((len(state.rows), bins), np.nan)
        chosen, event = state.frame(box.reshape(-1, 4), looks)
        return state, ([int(det[d]) for d in chosen], event)

    return folded(rows, clip, [frame], ["det", "box", "bins", "look"], step, "chosen array<bigint>, event string", True).select(clip, frame, "chosen", "event")
