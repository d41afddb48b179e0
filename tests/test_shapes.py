"""Simplifying, clipping and stitching against plain versions on random shapes, and the odd ones by hand."""

import random

import numpy as np

from driftline.operators import shapes

POINT = "shape_id long, pos long, e_m double, n_m double"


def lines(spark, shapes_):
    return spark.createDataFrame([(s, i, float(e), float(n)) for s, line in enumerate(shapes_) for i, (e, n) in enumerate(line)], POINT)


def gathered(rows, *by):
    out = {}
    for r in sorted(rows, key=lambda r: r.pos):
        out.setdefault(tuple(r[c] for c in by), []).append((r.e_m, r.n_m))
    return out


def split(line, lo, hi, tolerance):
    (ax, ay), (bx, by) = line[lo], line[hi]
    dx, dy = bx - ax, by - ay
    sq, far, k = dx * dx + dy * dy, tolerance * tolerance, None
    for i in range(lo + 1, hi):
        px, py = line[i][0] - ax, line[i][1] - ay
        t = max(0.0, min(1.0, (px * dx + py * dy) / sq)) if sq else 0.0
        d = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
        if d > far:
            far, k = d, i
    return {lo, hi} if k is None else split(line, lo, k, tolerance) | split(line, k, hi, tolerance)


def test_simplify(spark):
    rng = random.Random(2)
    made = [[(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.choice([1, 2, 3, 10, 40]))] for _ in range(60)] + [[(i, 0) for i in range(50)], [(0, 0), (9, 9), (0, 0)]]
    got = {}
    for r in shapes.simplified(lines(spark, made), 6.0).collect():
        got.setdefault(r.shape_id, []).append(r.pos)
    for s, line in enumerate(made):
        assert sorted(got[s]) == sorted(split(line, 0, len(line) - 1, 6.0)), s
    assert shapes.simplified(lines(spark, []), 6.0).collect() == []


def cut_ring(ring, west, south, east, north):
    for axis, at, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out = []
        for q, p in zip([*ring[-1:], *ring[:-1]], ring, strict=True):
            if ((p[axis] - at) * sign >= 0) != ((q[axis] - at) * sign >= 0):
                cross = q[1 - axis] + (p[1 - axis] - q[1 - axis]) * (at - q[axis]) / (p[axis] - q[axis])
                out.append((at, cross) if axis == 0 else (cross, at))
            if (p[axis] - at) * sign >= 0:
                out.append(p)
        ring = out
    return ring


def test_clip(spark):
    rng = random.Random(3)
    made = [[(rng.randint(-20, 40), rng.randint(-20, 40)) for _ in range(rng.randint(1, 15))] for _ in range(80)] + [[(1, 1), (2, 1), (2, 2)], [(-9, -9), (-8, -9), (-8, -8)]]
    box = (0.0, 2.0, 20.0, 15.0)
    rings = gathered(shapes.clipped_rings(lines(spark, made), *box).collect(), "shape_id")
    assert rings == {(s,): w for s, ring in enumerate(made) if (w := [(float(a), float(b)) for a, b in cut_ring(ring, *box)])}
    runs = gathered(shapes.clipped_lines(lines(spark, made), *box).collect(), "shape_id", "run")
    for s, line in enumerate(made):
        inside = [box[0] <= e <= box[2] and box[1] <= n <= box[3] for e, n in line]
        want, now = [], []
        for i, p in enumerate([*line, None]):
            if p is not None and any(inside[max(0, i - 1) : i + 2]):
                now.append((float(p[0]), float(p[1])))
            else:
                want += [now] if len(now) > 1 else []
                now = []
        assert [v for k, v in sorted(runs.items()) if k[0] == s] == want


def test_stitch(spark):
    """Rings come out whole whatever the order and direction of their ways; open ends, loops and single points."""
    rng = random.Random(4)
    rows, want = [], {}
    for shape in range(40):
        n = rng.choice([1, 2, 3, 7, 16, 33])
        corners = [(float(shape * 1000 + i), float(i * i % 97)) for i in range(n + 1)]
        shut = n > 2 and rng.random() < 0.6
        sides = [(corners[i], (corners[i][0] + 0.5, -1.0), corners[0] if shut and i == n - 1 else corners[i + 1]) for i in range(n)]
        ways = rng.sample(range(100), n)
        for way, side in zip(ways, sides, strict=True):
            for i, p in enumerate(side if rng.random() < 0.5 else side[::-1]):
                rows.append((shape, way, i, *p))
        want[shape] = (shut, min(ways), {frozenset((a, b)) for x in sides for a, b in zip(x, x[1:], strict=False)}, 2 * n + 1)
    rows += [(90, 5, i, *p) for i, p in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])] + [(91, 1, 0, 3.0, 3.0)]
    found = shapes.stitched(spark.createDataFrame(rows, "shape_id long, way long, pos long, e_m double, n_m double")).collect()
    rings = gathered(found, "shape_id", "ring", "closed")
    assert (90, 5, True) in rings and len(rings[90, 5, True]) == 4 and not any(k[0] == 91 for k in rings)
    for shape, (shut, least, sides, n) in want.items():
        (key,) = [k for k in rings if k[0] == shape]
        line = rings[key]
        assert key[1:] == (least, shut) and len(line) == n and (line[0] == line[-1]) == shut
        assert {frozenset(x) for x in zip(line, line[1:], strict=False)} == sides
    assert shapes.stitched(spark.createDataFrame([], "shape_id long, way long, pos long, e_m double, n_m double")).collect() == []


def test_lines_of_one_task_and_of_many_keep_the_same_points(spark, monkeypatch):
    """Short lines are settled at once and longer ones by rounds, to the same points; an odd coordinate sends a line by rounds."""
    rng = np.random.default_rng(8)
    rows = [(k, i, float(e), float(n)) for k, size in enumerate((1, 2, 3, 40, 90, 60)) for i, (e, n) in enumerate(rng.integers(0, 12, (size, 2)))]
    rows += [(9, i, float("nan") if i == 3 else float(i * i), 0.0) for i in range(6)]
    lines = spark.createDataFrame(rows, "shape_id long, pos long, e_m double, n_m double")
    want = {tuple(r) for r in shapes._by_rounds(lines, 2.0).collect()}
    for most in (2048, 50):
        monkeypatch.setattr(shapes, "SHORT", most)
        got = [tuple(r) for r in shapes.simplified(lines, 2.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want
