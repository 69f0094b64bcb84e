"""Tracks and targets as small tables."""

import json

from groundtrace.operators.quality import Policy
from groundtrace.plans.assessment import Assessment

SAMPLE = "track_id string, part_ord int, sample_ord bigint, record_index bigint, lon double, lat double, position_code string, ts_text string, ts_code string, altitude_m double, distance_m double, observed_speed_mps double"


def samples(spark, **tracks):
    """``name=[part, ...]``; a part is a list of (lon, lat[, time]); None is a sample without a position."""
    rows = []
    for name, parts in tracks.items():
        record = 0
        for p, part in enumerate(parts):
            for s, point in enumerate(part):
                lon, lat, *time = point if point is not None else (None, None)
                rows.append((name, p, s, record, None if lon is None else float(lon), None if lat is None else float(lat), "POSITION_MISSING" if point is None else None, time[0] if time else None, None, None, None, None))
                record += 1
    return spark.createDataFrame(rows, SAMPLE)


def rectangle(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


def multi(*polygons):
    return {"type": "MultiPolygon", "coordinates": [list(p) for p in polygons]}


def targets(spark, **shapes):
    return spark.createDataFrame([(n, json.dumps(s)) for n, s in shapes.items()], "target_id string, geometry string")


def assess(spark, parts, shape, cap=None, bounds=True):
    return Assessment(samples(spark, a=parts), targets(spark, t=shape), Policy(cap, bounds))


def told(spark, parts, shape, **options):
    """(relation, completeness, covered fragments, segments) of one pair."""
    a = assess(spark, parts, shape, **options)
    row = a.relations.first()
    covered = sorted((r.part_index, r.edge_index, r.lo, r.hi) for r in a.fragments.filter("covered").collect())
    return row.relation, row.completeness, covered, a.segments.count()
