"""The tracker against a plain version of its rules, one detection at a time, and on small scenes."""

import math
from collections import Counter

from tests.test_queries import SF
from tidewell.operators import tracking
from tidewell.plans import shapes


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def meet(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def alike(p, q):
    if p is None or q is None:
        return None
    return 1 - math.sqrt(max(1 - sum(math.sqrt(a * b) for a, b in zip(p, q, strict=True)), 0))


class Plain:
    """A list of dictionaries, plain loops."""

    def __init__(self, choose):
        self.choose, self.tracks = choose, []

    def expect(self, t):
        dx, dy = (t["drift"][i] + t["speed"][i] for i in (0, 1))
        b = t["box"]
        return (b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy)

    def new(self, d, target):
        return {"box": d[1], "look": d[2], "speed": (0, 0), "drift": (0, 0), "size": area(d[1]), "lost": 0, "blind": 0, "target": target}

    def select(self, dets):
        picked = self.choose(dets)
        self.tracks = [self.new(d, d in picked) for d in dets if d in picked or not any(self.double(d[1], p[1]) for p in picked)]
        return sorted(d[0] for d in picked), "chosen"

    def double(self, a, b):
        return meet(a, b) > 0.6 * max(min(area(a), area(b)), 1)

    def coast(self, t):
        t["drift"] = (t["drift"][0] + t["speed"][0], t["drift"][1] + t["speed"][1])
        t["blind"] += 1

    def miss(self, t):
        t["lost"] += 1
        self.coast(t)
        t["speed"] = (t["speed"][0] * 0.9, t["speed"][1] * 0.9)

    def frame(self, dets):
        targets = [t for t in self.tracks if t["target"]]
        if not dets:
            for t in self.tracks:
                self.miss(t)
            return [], "lost" if targets else "empty"
        if not targets:
            return self.select(dets)
        pairs = []
        for i, t in enumerate(self.tracks):
            for j, d in enumerate(dets):
                e = self.expect(t)
                m = meet(e, d[1])
                iou, look = m / max(area(e) + area(d[1]) - m, 1), alike(t["look"], d[2])
                if m > 0 and iou >= 0.15 and (look is None or look >= 0.35):
                    pairs.append((0.6 * iou + 0.4 * (0.5 if look is None else look), i, j))
        found = {}
        for _, i, j in sorted(pairs, reverse=True):
            if i not in found and j not in found.values():
                found[i] = j
        for i, t in enumerate(self.tracks):
            if t["target"] and i not in found:
                e = self.expect(t)
                e = (e[0] - 3, e[1] - 3, e[2] + 3, e[3] + 3)
                best = None
                for j, d in enumerate(dets):
                    look = alike(t["look"], d[2])
                    look = 0.5 if look is None else look
                    if j not in found.values() and meet(e, d[1]) > 0 and look >= 0.35 and (best is None or look > best[0]):
                        best = (look, j)
                if best:
                    found[i] = best[1]
        for i, t in enumerate(self.tracks):
            if i not in found:
                self.miss(t)
                continue
            b, size = dets[found[i]][1], area(dets[found[i]][1])
            merged = size > 1.5 * max(t["size"], 1) and any(o is not t and o["size"] >= 0.25 * size and meet(self.expect(o), b) > 0.2 * o["size"] for o in self.tracks)
            t["lost"] = 0
            if size < 0.7 * t["size"] or merged:
                self.coast(t)
                continue
            speed = tuple(0.5 * t["speed"][k] + 0.5 * ((b[k] + b[k + 2]) / 2 - (t["box"][k] + t["box"][k + 2]) / 2) / (t["blind"] + 1) for k in (0, 1))
            n = math.hypot(*speed)
            t["speed"] = speed if n <= 12.8 else tuple(v * 12.8 / n for v in speed)
            t["box"], t["drift"], t["blind"] = b, (0, 0), 0
            t["size"] = 0.7 * t["size"] + 0.3 * size if t["size"] else size
            t["look"] = dets[found[i]][2] or t["look"]
        event = "lost" if any(t["target"] and i not in found for i, t in enumerate(self.tracks)) else "followed"
        if all(t["lost"] > 8 for t in targets):
            free = [j for j in range(len(dets)) if j not in found.values()]
            pick = None
            if len(targets) == 1 and free:
                t = targets[0]
                looks = [(alike(t["look"], dets[j][2]), -j) for j in free]
                looks = [x for x in looks if x[0] is not None and x[0] >= 0.6]
                fresh = [dets[j] for j in free if area(dets[j][1]) >= 0.15 * t["size"]]
                if looks:
                    pick, event = -max(looks)[1], "recognised"
                elif fresh:
                    pick, event = dets.index(self.choose(fresh)[0]), "newcomer"
            if pick is not None:
                t |= {"box": dets[pick][1], "size": area(dets[pick][1]), "lost": 0, "blind": 0, "drift": (0, 0), "speed": (0, 0)}
                found[self.tracks.index(t)] = pick
            elif all(t["lost"] > 24 for t in targets):
                return self.select(dets)
        chosen = [found[i] for i, t in enumerate(self.tracks) if t["target"] and i in found]
        for j, d in enumerate(dets):
            if j not in found.values() and not any(self.double(d[1], dets[c][1]) for c in chosen):
                self.tracks.append(self.new(d, False))
        self.tracks = [t for t in self.tracks if t["target"] or t["lost"] <= 8]
        return sorted(dets[c][0] for c in chosen), event


def by_left(count):
    return lambda dets: sorted(dets, key=lambda d: (d[1][0] + d[1][2]) / 2)[:count]


def plain(rows, count):
    clips = {}
    for r in rows:
        dets = clips.setdefault(r["clip"], {}).setdefault(r["frame"], [])
        if r["det"] is not None:
            dets.append((r["det"], (r["x0"], r["y0"], r["x1"], r["y1"]), tuple(r["look"]) if r["look"] else None))
    out = {}
    for clip, frames in clips.items():
        state = Plain(by_left(count))
        for f in sorted(frames):
            chosen, event = state.frame(sorted(frames[f], key=lambda d: d[:2]))
            out[clip, f] = (chosen, event)
    return out


def test_clips(spark):
    rows = shapes.detections(spark, SF)
    for count in (1, 2):
        want = plain(rows.collect(), count)
        got = {(r["clip"], r["frame"]): (r["chosen"], r["event"]) for r in tracking.tracked(rows, "clip", "frame", tracking.by_position("left", count)).collect()}
        assert got == want
        events = Counter(e for _, e in got.values())
        assert {"chosen", "followed", "lost"} <= set(events), events


SCENE = "clip int, frame int, det long, x0 double, y0 double, x1 double, y1 double, look array<double>"
RED, BLUE = [0.9, 0.1, 0.0], [0.0, 0.1, 0.9]


def scene(spark, frames):
    rows = []
    for f, dets in enumerate(frames):
        rows += [(1, f, k, float(x), 0.0, float(x + w), 20.0, look) for k, x, w, look in dets] or [(1, f, None, None, None, None, None, None)]
    got = tracking.tracked(spark.createDataFrame(rows, SCENE), "clip", "frame", tracking.by_position("left", 1)).collect()
    assert plain(spark.createDataFrame(rows, SCENE).collect(), 1) == {(1, r["frame"]): (r["chosen"], r["event"]) for r in got}
    return [(r["chosen"], r["event"]) for r in sorted(got, key=lambda r: r["frame"])]


def test_crossing(spark):
    # Two walk through each other; the target keeps its look and its way.
    out = scene(spark, [[(1, 2 * f, 10, RED), (2, 60 - 2 * f, 10, BLUE)] for f in range(30)])
    assert all(chosen == [1] for chosen, _ in out)


def test_lost_and_recognised(spark):
    out = scene(spark, [[(1, 5, 10, RED), (2, 100, 10, BLUE)]] + [[(2, 100, 10, BLUE)]] * 12 + [[(7, 60, 10, RED), (2, 100, 10, BLUE)]])
    assert [e for _, e in out] == ["chosen", *["lost"] * 12, "recognised"] and out[-1][0] == [7]


def test_newcomer_and_chosen_again(spark):
    out = scene(spark, [[(1, 5, 10, RED)]] + [[]] * 10 + [[(9, 80, 10, BLUE)]])
    assert out[-1] == ([9], "newcomer")
    out = scene(spark, [[(1, 5, 10, RED), (2, 100, 10, BLUE)]] + [[(2, 100, 10, BLUE)]] * 25)
    assert out[-1] == ([2], "chosen") and out[-2][1] == "lost"


def test_unknown_looks_and_merged(spark):
    out = scene(spark, [[(1, 5, 10, None), (2, 30, 10, None)], [(1, 6, 10, None), (2, 28, 10, None)], [(3, 7, 31, None)], [(1, 8, 10, None), (2, 24, 10, None)]])
    assert out[0] == ([1], "chosen") and out[-1] == ([1], "followed")
    assert scene(spark, [[], []]) == [([], "empty"), ([], "empty")]
