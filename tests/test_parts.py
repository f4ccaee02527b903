"""Parts of masks and suppression against plain versions."""

import random

import pytest

from tidewell.operators import parts

CELLS = "g string, inst string, x int, y int, conf double"


def flooded(cells):
    left, out = set(cells), {}
    while left:
        seed = min(left, key=lambda c: (c[1], c[0]))
        part, todo = {seed}, [seed]
        while todo:
            x, y = todo.pop()
            for c in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if c in left and c not in part:
                    part.add(c)
                    todo.append(c)
        left -= part
        out |= {c: seed[1] * parts.ROW + seed[0] for c in part}
    return out


def scattered(n, side, seed):
    r = random.Random(seed)
    return {(r.randrange(side), r.randrange(side)) for _ in range(n)}


SPIRAL = {(x, 0) for x in range(12)} | {(11, y) for y in range(12)} | {(x, 11) for x in range(12)} | {(0, y) for y in range(2, 12)} | {(x, 2) for x in range(10)} | {(9, y) for y in range(2, 10)}
DIAGONAL = {(i, i) for i in range(20)} | {(19 - i, i) for i in range(0, 6)}


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_connected_parts(spark, tile):
    images = {"spiral": SPIRAL, "diagonal": DIAGONAL, "one": {(5, 5)}} | {f"r{i}": scattered(40 + 30 * i, 20, i) for i in range(5)}
    rows = [(g, None, x, y, None) for g, cells in images.items() for x, y in cells] + [("one", None, 5, 5, None)]
    got = parts.connected_parts(spark.createDataFrame(rows, CELLS), "g", tile).collect()
    assert len(got) == sum(map(len, images.values()))
    assert {(r["g"], r["x"], r["y"], r["part"]) for r in got} == {(g, x, y, p) for g, cells in images.items() for (x, y), p in flooded(cells).items()}


def test_no_cells(spark):
    assert parts.connected_parts(spark.createDataFrame([], CELLS), "g").count() == 0


def owned(target, others, mode):
    union, taken = {c for c, _ in target}, set()
    conf, bottom = max(f for _, f in target), max(y for (_, y), _ in target)
    for cells in others.values():
        c, b = max(f for _, f in cells), max(y for (_, y), _ in cells)
        if mode == "subtract" or mode == "conf" and c > conf or mode == "front" and (b > bottom or b == bottom and c > conf):
            taken |= {p for p, _ in cells}
    left = union - taken
    if mode == "off" or len(left) < 0.5 * len(union):
        return union
    part = flooded(left)
    kept = {c for c in left if list(part.values()).count(part[c]) >= 0.04 * len(union)}
    return kept or left


@pytest.mark.parametrize("mode", ["off", "subtract", "conf", "front"])
def test_exclusive_mask(spark, mode):
    target, others = [], []
    for i in range(8):
        target += [(f"g{i}", "t", x, y, (x + i) % 5 / 10) for x, y in scattered(120, 14, i)]
        others += [(f"g{i}", f"o{k}", x, y, (k + y) % 7 / 10) for k in range(3) for x, y in scattered(15 + 9 * i, 12 + k, 100 * i + k)]
    got = {(r["g"], r["x"], r["y"]) for r in parts.exclusive_mask(spark.createDataFrame(target, CELLS), spark.createDataFrame(others, CELLS), "g", "inst", mode, 5).collect()}
    want = set()
    for i in range(8):
        mine = [((x, y), f) for g, _, x, y, f in target if g == f"g{i}"]
        theirs = {k: [((x, y), f) for g, inst, x, y, f in others if (g, inst) == (f"g{i}", k)] for k in ("o0", "o1", "o2")}
        want |= {(f"g{i}", *c) for c in owned(mine, theirs, mode)}
    assert got == want


def test_suppressed(spark):
    r = random.Random(4)
    rows = []
    for image in range(4):
        for k in range(90):
            x, y, w, h = r.randrange(40), r.randrange(40), r.randrange(0, 25), r.randrange(1, 25)
            rows.append((image, k, "ab"[k % 2], r.randrange(8) / 8, float(x), float(y), float(x + w), float(y + h)))
    want = set()
    for image in range(4):
        kept = []
        for b in sorted((b for b in rows if b[0] == image), key=lambda b: (-b[3], b[1]))[:70]:
            def over(a, b=b):
                i = max(min(a[6], b[6]) - max(a[4], b[4]), 0) * max(min(a[7], b[7]) - max(a[5], b[5]), 0)
                return a[2] == b[2] and i > 0.4 * ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - i)
            if not any(map(over, kept)):
                kept.append(b)
        want |= {(image, b[1], i + 1) for i, b in enumerate(kept[:30])}
    df = spark.createDataFrame(rows, "image int, k int, label string, conf double, x0 double, y0 double, x1 double, y1 double")
    assert {(b["image"], b["k"], b["place"]) for b in parts.suppressed(df, "image", "label", "conf", "k", 0.4, 70, 30).collect()} == want
    assert parts.suppressed(df.where("false"), "image", "label", "conf", "k").count() == 0
