"""Scenarios with hand-computed relations, segments and intervals."""

import pytest
from helpers import assess, multi, polygon, rectangle, told

SQUARE = polygon(rectangle(0, 0, 2, 2))
WORLD = polygon(rectangle(-180, -90, 180, 90))
BLOCK = polygon(rectangle(112, 28, 113, 29))
NEAR = polygon(rectangle(-10, -10, 10, 10))

# Coordinates of published scenarios, so that results can be compared with those told for them; the witnesses of rounding can't be others.
CASES = [
    ("crossing", [[(112.895, 28.205), (112.905, 28.205), (112.915, 28.205)]], polygon(rectangle(112.9, 28.2, 112.91, 28.21)), "partial", "complete", 1),
    ("inside", [[(112.25, 28.25), (112.5, 28.5), (112.75, 28.75)]], BLOCK, "inside", "complete", 1),
    ("outside", [[(110, 27), (110.5, 27.5), (111, 27.75)]], BLOCK, "outside", "complete", 0),
    ("repeated entry", [[(111.5, 28.25), (112.5, 28.25), (113.5, 28.25), (113.5, 28.75), (112.5, 28.75), (111.5, 28.75)]], BLOCK, "partial", "complete", 2),
    ("starts inside", [[(112.5, 28.5), (113.5, 28.5), (114, 28.5)]], BLOCK, "partial", "complete", 1),
    ("point touch", [[(111, 27), (112, 28), (111, 29)]], BLOCK, "outside", "complete", 0),
    ("along the boundary", [[(111, 28), (112, 28), (113, 28), (114, 28)]], BLOCK, "partial", "complete", 1),
    ("gap", [[(110.5, 28.5), (111.5, 28.5)], [(113.5, 28.5), (114.5, 28.5)]], BLOCK, "unknown", "incomplete", 0),
    ("two polygons", [[(x + 0.5, 28.5) for x in range(111, 116)]], multi([rectangle(112, 28, 113, 29)], [rectangle(114, 28, 115, 29)]), "partial", "complete", 2),
    ("hole", [[(x + 0.5, 29) for x in range(111, 117)]], polygon(rectangle(112, 28, 116, 30), rectangle(113, 28.5, 115, 29.5)), "partial", "complete", 2),
    ("partial with gaps", [[(111.5, 28.25), (112.5, 28.25), (113.5, 28.25)], [(110.5, 28.75), (111.5, 28.75)], [(113.5, 28.75), (114.5, 28.75)]], BLOCK, "partial", "incomplete", 1),
    ("there and back", [[(0, 0), (1, 0), (0, 0)]], NEAR, "inside", "complete", 1),
    ("equal parts", [[(0, 0), (1, 0)], [(0, 0), (1, 0)]], NEAR, "unknown", "incomplete", 2),
    ("in and out and in", [[(-1, 0), (2, 0), (-1, 0)]], polygon(rectangle(0, -1, 1, 1)), "partial", "complete", 2),
    ("very short", [[(0, 0), (5e-13, 0)]], NEAR, "inside", "complete", 1),
    ("underflow", [[(0, 0), (1e-200, 0)]], NEAR, "inside", "complete", 1),
    ("roundoff at an axis", [[(-0.1, 0), (0.2, 0)]], polygon(rectangle(0, -1, 0.1, 1)), "partial", "complete", 1),
    ("roundoff off axis", [[(-1, 0.3636463558725396), (2, -0.32739649147321576)]], polygon(rectangle(0, -1, 1, 1)), "partial", "complete", 1),
    ("repeated coordinates", [[(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0)]], NEAR, "inside", "complete", 1),
    ("world with gaps", [[(0, 0), (1, 0)], [(0, 0), (1, 0)]], WORLD, "inside", "incomplete", 2),
    ("sliver", [[(0, 0), (1, 0)]], polygon([[0, -1], [1e-13, -1], [1e-13, 1], [0, 1], [0, -1]]), "partial", "complete", 1),
    ("boundary only", [[(0, 0), (2, 0)]], SQUARE, "inside", "complete", 1),
    ("diagonal touch", [[(-1, 1), (1, -1)]], SQUARE, "outside", "complete", 0),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_relation(spark, case):
    _, parts, shape, relation, completeness, segments = case
    found = told(spark, parts, shape)
    assert (found[0], found[1], found[3]) == (relation, completeness, segments)


def test_intervals(spark):
    assert told(spark, [[(-1, 1), (3, 1)]], SQUARE)[2] == [(0, 0, 0.25, 0.75)]
    assert told(spark, [[(1, 1), (3, 1)]], SQUARE)[2] == [(0, 0, 0.0, 0.5)]
    ring = polygon(rectangle(-2, -2, 2, 2), rectangle(-0.5, -0.5, 0.5, 0.5))
    assert told(spark, [[(-1, 0), (1, 0)]], ring)[2] == [(0, 0, 0.0, 0.25), (0, 0, 0.75, 1.0)]
    a = assess(spark, [[(-1, 1), (3, 1), (-1, 1), (3, 1)]], SQUARE)
    assert a.fragments.filter("covered").count() == 3 and a.fragments.filter("NOT covered").count() == 6


def test_domain_bounds_off(spark):
    parts = [[(0, 0), (1, 0)], [(2, 0), (3, 0)]]
    assert told(spark, parts, WORLD)[:2] == ("inside", "incomplete")
    assert told(spark, parts, WORLD, bounds=False)[:2] == ("unknown", "incomplete")


def test_without_length(spark):
    for parts, still in (([[(1, 1)]], 0), ([[(1, 1), (1, 1), (1, 1)]], 2)):
        a = assess(spark, parts, SQUARE)
        row = a.relations.first()
        assert (row.assessable, row.relation, row.completeness, row.reason) == (False, None, None, "NO_POSITIVE_LENGTH_USABLE_GEOMETRY")
        assert a.stationary.filter("covered").count() == still and a.segments.count() == 0


def test_fraction_one_is_the_next_observation(spark):
    row = assess(spark, [[(-1, 1), (0, 1), (1, 1)]], SQUARE).segments.first()
    assert tuple(row.start) == (0, 1, 0.0) and tuple(row.end) == (0, 2, 0.0)


@pytest.mark.parametrize(
    "edge, shape, status",
    [
        ([(-9e-200, 0), (1.8e-199, 0)], polygon([[8e-200, -1], [1e-199, -1], [1e-199, 1], [8e-200, 1], [8e-200, -1]]), "SPATIAL_NUMERICAL_BOUNDARY_UNRESOLVED"),
        ([(0.099, 0.375), (0.101, 0.375)], polygon([[0.1, 0.375 + 2**-56 * 1.0], [0.1 - 1.3877787807814457e-17, 0.375], [0.1, 0.375 - 2**-56], [0.1 + 1.3877787807814457e-17, 0.375], [0.1, 0.375 + 2**-56]]), None),
        ([(-1, 0), (1, 0)], polygon([[0, -1], [1e-160, -1], [1e-160, 1], [0, 1], [0, -1]]), "SPATIAL_FRACTION_UNREPRESENTABLE"),
    ],
)
def test_what_doubles_cannot_hold_is_refused(spark, edge, shape, status):
    row = assess(spark, [edge], shape).relations.first()
    if status:
        assert (row.status, row.relation, row.assessable) == (status, None, None)
    else:
        assert row.status != "OK" or row.relation in ("outside", "partial")


def test_usable_runs_and_gap_of_a_jump(spark):
    times = [f"2024-01-01T00:00:{s}Z" for s in ("00", "10", "20", "30")]
    part = [(x, 0, t) for x, t in zip((0, 0.001, 1.0, 1.001), times, strict=True)]
    a = assess(spark, [part], polygon(rectangle(0.2, -1, 0.8, 1)), cap=100.0)
    from groundtrace.operators.quality import usable_intervals

    assert sorted((r.low, r.high) for r in usable_intervals(a.decided.drop("run")).collect()) == [(0, 1), (2, 3)]
    assert [(r.kind, r.causes) for r in a.gaps.collect()] == [("quality_exclusion", ["IMPLIED_SPEED_EXCEEDS_POLICY"])]
    row = a.relations.first()
    assert (row.relation, row.completeness) == ("unknown", "incomplete")
    assert {r.decision for r in assess(spark, [part], SQUARE).decided.collect()} == {"SPEED_RULE_DISABLED"}
