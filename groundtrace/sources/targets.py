"""Target areas: GeoJSON polygons and multipolygons as rows of ring segments, and their validation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Targets up to which a table of one small row for each is sent to every executor; beyond, the join is left to the planner.
BROADCAST_TARGETS = 10_000
#: Boxes that are compared with their neighbours at a time, and relative rounding of a difference of two products.
BOXES_AT_ONCE, DOUBT = 256, 2e-15

#: The targets of the catalogue's queries, on the grid of ``sources.events``.
CATALOGUE = {
    "T1": {"type": "Polygon", "coordinates": [[[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5], [-0.5, -0.5]]]},
    "T2": {
        "type": "Polygon",
        "coordinates": [
            [[-0.75, -0.75], [0.75, -0.75], [0.75, 0.75], [-0.75, 0.75], [-0.75, -0.75]],
            [[-0.25, -0.25], [0.25, -0.25], [0.25, 0.25], [-0.25, 0.25], [-0.25, -0.25]],
        ],
    },
    "T3": {
        "type": "MultiPolygon",
        "coordinates": [
            [[[-1.0, -1.0], [-0.5, -1.0], [-0.5, 0.0], [-1.0, 0.0], [-1.0, -1.0]]],
            [[[0.25, -0.5], [0.875, -0.5], [0.875, 0.5], [0.25, 0.5], [0.25, -0.5]]],
        ],
    },
    "T4": {"type": "Polygon", "coordinates": [[[0.0, 0.75], [-0.75, 0.0], [0.0, -0.75], [0.75, 0.0], [0.0, 0.75]]]},
    "T5": {"type": "Polygon", "coordinates": [[[10.0, 10.0], [11.0, 10.0], [11.0, 11.0], [10.0, 11.0], [10.0, 10.0]]]},
    "T6": {"type": "Polygon", "coordinates": [[[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0], [-180.0, -90.0]]]},
    "T7": {"type": "Polygon", "coordinates": [[[-0.25, 0.0], [0.5, 0.0], [0.5, 0.875], [-0.25, 0.875], [-0.25, 0.0]]]},
}


def catalogue(spark: SparkSession, *names: str) -> DataFrame:
    """(target_id, geometry) of the catalogue, all of it or the named ones."""
    return spark.createDataFrame([(n, json.dumps(CATALOGUE[n])) for n in names or CATALOGUE], "target_id string, geometry string")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, revision_id, geometry) of target-area documents, one JSON document a file or a line."""
    raw = spark.read.option("multiLine", True).json(path, schema="id string, revision_id string, geometry struct<type: string, coordinates: string>")
    return raw.select(F.col("id").alias("target_id"), "revision_id", F.concat(F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), F.col("geometry.coordinates"), F.lit("}")).alias("geometry"))


def polygons(geometry: Column) -> Column:
    """array<polygon array<ring array<struct(ax, ay, bx, by)>>> of GeoJSON text; the first ring of a polygon is its outer one."""
    text = F.get_json_object(geometry, "$.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    many = F.from_json(text, "array<array<array<array<double>>>>")
    rings = F.when(F.get_json_object(geometry, "$.type") == "Polygon", one).otherwise(many)

    def segments(ring: Column) -> Column:
        return F.transform(
            F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
            lambda p, i: F.struct(p[0].alias("ax"), p[1].alias("ay"), ring[i + 1][0].alias("bx"), ring[i + 1][1].alias("by")),
        )

    return F.transform(rings, lambda polygon: F.transform(polygon, segments))


def prepared(targets: DataFrame) -> DataFrame:
    """``targets`` (target_id, geometry) with ``polys`` and its box."""
    rows = targets.select("target_id", polygons(F.col("geometry")).alias("polys"))
    xs, ys = F.flatten(F.flatten("polys"))["ax"], F.flatten(F.flatten("polys"))["ay"]
    box = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return rows.withColumn("box", box)


def shared_ids(rows: DataFrame) -> DataFrame:
    """A table of one small row for each target, broadcast if its counted size allows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else rows


def ring_segments(targets: DataFrame) -> DataFrame:
    """(target_id, polygon, ring, segment, ax, ay, bx, by, is_hole)."""
    rows = prepared(targets).select("target_id", F.posexplode("polys").alias("polygon", "rings"))
    rows = rows.select("target_id", "polygon", F.posexplode("rings").alias("ring", "segments"))
    rows = rows.select("target_id", "polygon", "ring", F.posexplode("segments").alias("segment", "s"))
    return rows.select("target_id", "polygon", "ring", "segment", "s.*", (F.col("ring") > 0).alias("is_hole"))


def rings_closed(targets: DataFrame) -> DataFrame:
    """(target_id, polygon, ring, positions, closed)."""
    rows = prepared(targets).select("target_id", F.posexplode("polys").alias("polygon", "rings"))
    rows = rows.select("target_id", "polygon", F.posexplode("rings").alias("ring", "s"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    return rows.select("target_id", "polygon", "ring", (F.size("s") + 1).alias("positions"), ((first["ax"] == last["bx"]) & (first["ay"] == last["by"])).alias("closed"))


def _cross(a: tuple, b: tuple, c: tuple) -> Fraction:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _meets(a: tuple, b: tuple, c: tuple, d: tuple) -> tuple[bool, bool]:
    """(have a point in common, cross or overlap in more than end points) of two segments."""
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return False, False
    sides = [_cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b)]
    if not any(sides):
        axis = 0 if a[0] != b[0] else 1
        low = max(min(a[axis], b[axis]), min(c[axis], d[axis]))
        high = min(max(a[axis], b[axis]), max(c[axis], d[axis]))
        return True, low < high
    if sides[0] * sides[1] > 0 or sides[2] * sides[3] > 0:
        return False, False
    return True, sides[0] * sides[1] < 0 and sides[2] * sides[3] < 0


def _meeting(boxes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of boxes (min_x, min_y, max_x, max_y) that meet, by a sweep from west to east."""
    order = np.argsort(boxes[:, 0], kind="stable")
    west, south, east, north = boxes[order].T
    for low in range(0, len(order), BOXES_AT_ONCE):
        high = min(low + BOXES_AT_ONCE, len(order))
        last = int(np.searchsorted(west, east[low:high].max(), "right"))
        meet = (west[low:last] <= east[low:high, None]) & (south[low:last] <= north[low:high, None]) & (north[low:last] >= south[low:high, None])
        one, two = np.nonzero(meet)
        later = two > one
        yield from zip(order[low + one[later]].tolist(), order[low + two[later]].tolist(), strict=True)


def _boxes(ends: np.ndarray) -> np.ndarray:
    """Boxes of segments (ax, ay, bx, by)."""
    return np.concatenate([np.minimum(ends[:, :2], ends[:, 2:]), np.maximum(ends[:, :2], ends[:, 2:])], axis=1)


class _Ring(NamedTuple):
    polygon: int
    hole: bool
    points: list[tuple[Fraction, Fraction]]  # the last one is the first
    ends: np.ndarray  # a row (ax, ay, bx, by) for each segment
    box: np.ndarray


def _ring(polygon: int, number: int, points: list) -> _Ring:
    plain = np.array(points, float)
    box = np.concatenate([plain.min(axis=0), plain.max(axis=0)])
    return _Ring(polygon, number > 0, [(Fraction(x), Fraction(y)) for x, y in points], np.concatenate([plain[:-1], plain[1:]], axis=1), box)


def _exact_place(point: tuple[Fraction, Fraction], ring: _Ring) -> int:
    """1 inside, 0 on, -1 outside."""
    x, y = point
    turns = 0  # how often the ring winds around the point
    for (ax, ay), (bx, by) in zip(ring.points, ring.points[1:], strict=False):
        side = _cross((ax, ay), (bx, by), point)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if ay <= y < by and side > 0:
            turns += 1
        elif by <= y < ay and side < 0:
            turns -= 1
    return 1 if turns else -1


def _places(inner: _Ring, outer: _Ring) -> set[int]:
    """Where the corners of a ring and the middles of its sides lie in another one: 1 inside, 0 on, -1 outside. Doubles first."""
    corners, middles = inner.ends[:, :2], (inner.ends[:, :2] + inner.ends[:, 2:]) / 2
    exact = [*inner.points[:-1], *(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(inner.points, inner.points[1:], strict=False))]
    ax, ay, bx, by = outer.ends.T
    out: set[int] = set()
    for at, (x, y) in enumerate(np.concatenate([corners, middles]).tolist()):
        p, q = (bx - ax) * (y - ay), (by - ay) * (x - ax)
        if (np.abs(p - q) <= DOUBT * (np.abs(p) + np.abs(q) + 360)).any():
            out.add(_exact_place(exact[at], outer))
        else:
            out.add(1 if (((ay > y) != (by > y)) & ((p > q) == (by > ay))).sum() % 2 else -1)
        if {1, -1} <= out:
            break
    return out


def _within(inner: _Ring, outer: _Ring) -> bool:
    """Whether no point of a ring is outside another that it doesn't cross."""
    if (inner.box[:2] < outer.box[:2]).any() or (inner.box[2:] > outer.box[2:]).any():
        return False
    places = _places(inner, outer)
    return -1 not in places and 1 in places


def _crossed(rings: list[_Ring]) -> bool:
    """Whether two segments cross or overlap, or touch within one ring without being neighbours."""
    at = [(r, k) for r, ring in enumerate(rings) for k in range(len(ring.ends))]
    for i, j in _meeting(_boxes(np.concatenate([ring.ends for ring in rings]))):
        (r, k), (s, m) = sorted((at[i], at[j]))
        touch, cross = _meets(*rings[r].points[k : k + 2], *rings[s].points[m : m + 2])
        beside = r == s and (m == k + 1 or (k == 0 and m == len(rings[r].ends) - 1))
        if cross or (touch and r == s and not beside):
            return True
    return False


def _misplaced(rings: list[_Ring]) -> bool:
    """Whether a hole isn't in its polygon, holes of a polygon lie in each other, or a polygon lies in another's inside."""
    outers = {ring.polygon: ring for ring in rings if not ring.hole}
    holes: dict[int, list[_Ring]] = {}
    for ring in rings:
        if ring.hole:
            holes.setdefault(ring.polygon, []).append(ring)
            if not _within(ring, outers[ring.polygon]):
                return True
    for i, j in _meeting(np.array([ring.box for ring in rings])):
        one, two = rings[i], rings[j]
        if one.hole and two.hole and one.polygon == two.polygon and (_within(one, two) or _within(two, one)):
            return True
        if not one.hole and not two.hole:
            for inner, outer in ((one, two), (two, one)):
                if _within(inner, outer) and not any(_within(inner, hole) for hole in holes.get(outer.polygon, ())):
                    return True
    return False


def topology_code(geometry: str) -> str | None:
    """Null for a valid target, else what is wrong with it."""
    try:
        shape = json.loads(geometry)
        many = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[shape["type"]](shape["coordinates"])
        if not many or any(not polygon for polygon in many):
            return "TARGET_SCHEMA_INVALID"
        for x, y in (point for polygon in many for ring in polygon for point in ring):
            if type(x) not in (int, float) or type(y) not in (int, float) or not (abs(x) <= 180 and abs(y) <= 90):
                return "TARGET_SCHEMA_INVALID"
    except (ValueError, KeyError, TypeError, OverflowError):
        return "TARGET_SCHEMA_INVALID"
    if any(len(ring) < 4 or ring[0] != ring[-1] for polygon in many for ring in polygon):
        return "TARGET_RING_NOT_CLOSED"
    rings = [_ring(p, r, ring) for p, polygon in enumerate(many) for r, ring in enumerate(polygon)]
    flat = any(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring.points, ring.points[1:], strict=False)) == 0 for ring in rings)
    standing = any((ring.ends[:, :2] == ring.ends[:, 2:]).all(axis=1).any() for ring in rings)
    return "TARGET_TOPOLOGY_INVALID" if flat or standing or _crossed(rings) or _misplaced(rings) else None


def judged(targets: DataFrame) -> DataFrame:
    """``targets`` (target_id, geometry) with ``code``, null where they are valid."""
    check = F.arrow_udf(lambda texts: pa.array([topology_code(t.as_py()) if t.as_py() is not None else "TARGET_SCHEMA_INVALID" for t in texts], pa.string()), "string")
    return targets.select("target_id", "geometry", check.asNondeterministic()("geometry").alias("code"))  # so that a filter on it doesn't compute it again


def target_issues(targets: DataFrame) -> DataFrame:
    """(target_id, code) of invalid targets."""
    return judged(targets).filter("code IS NOT NULL").select("target_id", "code")
