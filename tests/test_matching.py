"""One-to-one matches against plain loops."""

import random

from tidewell.operators.vision import matched


def loop(pairs, in_row_order):
    order = (lambda p: (p[1], -p[3], p[2])) if in_row_order else (lambda p: (-p[3], -p[1], -p[2]))
    out, left, right = set(), set(), set()
    for g, a, b, s in sorted(pairs, key=lambda p: (p[0], *order(p))):
        if s > 0 and (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.add((g, a, b, s))
    return out


def test_matches(spark):
    r = random.Random(2)
    pairs = [(g, a, b, r.choice([0.0, 0.2, 0.5, 0.5, 0.9])) for g in range(12) for a in range(r.randrange(5)) for b in range(4)]
    df = spark.createDataFrame(pairs, "g long, a long, b long, s double").repartition(3)
    for way in (True, False):
        assert {tuple(x) for x in matched(df, "g", "a", "b", "s", way).collect()} == loop(pairs, way)
    assert matched(df.where("false"), "g", "a", "b", "s", True).count() == 0
