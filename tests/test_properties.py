"""Random edges and targets against brute force, and intervals tile their edges."""

import random
from fractions import Fraction

import numpy as np
from helpers import multi, polygon, rectangle, samples, targets

from groundtrace.operators import clip, normalize, quality
from groundtrace.sources.targets import prepared

SHAPES = {
    "box": polygon(rectangle(-0.5, -0.5, 0.5, 0.5)), "ring": polygon(rectangle(-0.75, -0.75, 0.75, 0.75), rectangle(-0.25, -0.25, 0.25, 0.25)),
    "two": multi([rectangle(-1, -1, -0.5, 0)], [rectangle(0.25, -0.5, 0.875, 0.5)]), "diamond": polygon([[0, 0.75], [-0.75, 0], [0, -0.75], [0.75, 0], [0, 0.75]]),
    "third": polygon([[0.1, 0.1], [0.7, 0.2], [1 / 3, 0.9], [0.1, 0.1]]),
}


def _points(n, seed):
    rng = random.Random(seed)
    grid = [(rng.randrange(-16, 17) / 16, rng.randrange(-16, 17) / 16) for _ in range(n)]
    free = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n)]
    tenths = [(rng.randrange(-10, 11) / 10, rng.randrange(-10, 11) / 10) for _ in range(n)]
    return [grid, free, tenths]


def brute_pieces(edge, rings):
    """Intervals by the definition: cut at every place where the edge meets a ring, and look at the middle of each interval with exact numbers."""
    (x0, y0, x1, y1), rings = map(Fraction, edge), [[tuple(map(Fraction, s)) for s in ring] for ring in rings]
    dx, dy = x1 - x0, y1 - y0
    places = {Fraction(0), Fraction(1)}
    for ax, ay, bx, by in (s for ring in rings for s in ring):
        # a + u * (b - a) = p + t * d, by Cramer's rule; a parallel segment only adds its ends
        if det := dx * (by - ay) - dy * (bx - ax):
            t, u = ((ax - x0) * (by - ay) - (ay - y0) * (bx - ax)) / det, ((ax - x0) * dy - (ay - y0) * dx) / det
            places |= {t} if 0 <= u <= 1 else set()
        else:
            places |= {((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy) for x, y in ((ax, ay), (bx, by))}
    order, out = sorted(t for t in places if 0 <= t <= 1), []
    for lo, hi in zip(order, order[1:], strict=False):
        x, y = x0 + (lo + hi) / 2 * dx, y0 + (lo + hi) / 2 * dy
        sides = [((bx - ax) * (y - ay) - (by - ay) * (x - ax), (ax, ay, bx, by)) for ring in rings for ax, ay, bx, by in ring]
        on = any(not s and min(q[0], q[2]) <= x <= max(q[0], q[2]) and min(q[1], q[3]) <= y <= max(q[1], q[3]) for s, q in sides)
        east = sum((q[1] > y) != (q[3] > y) and (s > 0) == (q[3] > q[1]) for s, q in sides)
        if out and out[-1][2] == (on or east % 2 == 1):
            out[-1] = (out[-1][0], hi, out[-1][2])
        else:
            out.append((lo, hi, on or east % 2 == 1))
    return out


def test_pieces_equal_the_definition(spark):
    """Array and whole-number sweep against brute force, on the grid and off it; most rows are OK and none is wrong."""
    edges = quality.edges(normalize.observations(samples(spark, a=_points(160, 5))))
    shapes = targets(spark, **SHAPES)
    rings = {r.target_id: [[(s.ax, s.ay, s.bx, s.by) for s in ring] for p in r.polys for ring in p] for r in prepared(shapes).collect()}
    ends = {(r.part_index, r.edge_index): (r.x0, r.y0, r.x1, r.y1) for r in edges.collect()}
    found = {}
    for r in clip.fragments(edges, shapes).collect():
        found.setdefault((r.part_index, r.edge_index, r.target_id), []).append((r.fragment, r.lo, r.hi, r.covered, r.status))
    assert len(found) > 2000
    good = 0
    for (part, edge, target), rows in found.items():
        expected = brute_pieces(ends[part, edge], rings[target])
        assert clip.exact_pieces(ends[part, edge], [s for ring in rings[target] for s in ring]) == expected
        rows.sort()
        assert [r[0] for r in rows] == [*range(len(expected))] and len({r[4] for r in rows}) == 1
        good += rows[0][4] == "OK"
        for (_, lo, hi, covered, _), (a, b, c) in zip(rows, expected, strict=True):
            assert covered == c and abs(lo - float(a)) < 1e-12 and abs(hi - float(b)) < 1e-12
        assert rows[0][1] == 0 and rows[-1][2] == 1 and all(x[2] == y[1] for x, y in zip(rows, rows[1:], strict=False))
    assert good >= 0.95 * len(found)


def test_points_equal_the_definition():
    rng = random.Random(9)
    for name, shape in SHAPES.items():
        many = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
        segments = [(*a, *b) for polygon in many for ring in polygon for a, b in zip(ring, ring[1:], strict=False)]
        points = [(rng.randrange(-16, 17) / 16, rng.randrange(-16, 17) / 16) for _ in range(300)] + [(rng.randrange(-10, 11) / 10, rng.randrange(-10, 11) / 10) for _ in range(100)]
        points += [(s[0] + (s[2] - s[0]) * t, s[1] + (s[3] - s[1]) * t) for s in segments for t in (0, 0.5, 1 / 3, 0.1)]
        got = clip.points_covered(np.array(points, float), clip.area_of(name, np.array(segments, float)))
        for point, covered in zip(points, got.tolist(), strict=True):
            (x, y), odd, on = map(Fraction, point), 0, False
            for ax, ay, bx, by in [tuple(map(Fraction, s)) for s in segments]:
                side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                on |= side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
                odd ^= (ay > y) != (by > y) and (side > 0) == (by > ay)
            assert covered == (on or bool(odd))


def test_targets_in_blocks_give_the_same(spark, monkeypatch):
    edges = quality.edges(normalize.observations(samples(spark, a=_points(20, 6))))
    whole = sorted(map(tuple, clip.fragments(edges, targets(spark, **SHAPES)).collect()))
    monkeypatch.setattr(clip, "BLOCK_SEGMENTS", 1)
    monkeypatch.setattr(clip, "CELLS", 9)
    monkeypatch.setattr(clip, "TARGETS_AT_ONCE", 2)
    assert sorted(map(tuple, clip.fragments(edges, targets(spark, **SHAPES)).collect())) == whole
    assert clip.fragments(edges, targets(spark, **SHAPES).limit(0)).count() == 0
