"""Normalisation, screening, time, export, map, verifiers."""

import json

import pytest
from helpers import assess, multi, polygon, rectangle, samples, targets
from pyspark.sql import functions as F

from groundtrace.functions import canonical, geodesy, scalars
from groundtrace.operators import export, mapview, normalize, temporal, verify
from groundtrace.operators.quality import Policy
from groundtrace.plans.assessment import Assessment
from groundtrace.sources import targets as areas

WORLD = polygon(rectangle(-180, -90, 180, 90))
SQUARE = polygon(rectangle(0, 0, 2, 2))


def test_parts_and_neighbours(spark):
    own = samples(spark, a=[[(0, 0), None, None, (1, 0), (2, 0)], [(3, 0)]], b=[[None]], c=[[None, (0, 0), None]])
    seen = {(r.track_id, r.record_index): (r.part_index, r.observation_index) for r in normalize.observations(own).collect()}
    assert seen == {("a", 0): (0, 0), ("a", 3): (1, 0), ("a", 4): (1, 1), ("a", 5): (2, 0), ("c", 1): (0, 0)}
    said = [(r.track_id, r.code, r.previous and tuple(r.previous), r.next and tuple(r.next)) for r in normalize.diagnostics(own).orderBy("track_id", "diagnostic_index").collect()]
    assert said == [
        ("a", "POSITION_MISSING", (0, 0), (1, 0)), ("a", "POSITION_MISSING", (0, 0), (1, 0)), ("a", "SOURCE_CONTINUITY_BREAK", (1, 1), (2, 0)),
        ("b", "POSITION_MISSING", None, None), ("c", "POSITION_MISSING", None, (0, 0)), ("c", "POSITION_MISSING", (0, 0), None),
    ]
    assert {r.track_id: r.outcome for r in normalize.outcomes(own).collect()} == {"a": "success", "b": "no_positioned_observations", "c": "success"}


def test_empty_parts_are_said(spark):
    own = samples(spark, a=[[(0, 0)], [], [(1, 0)]])
    parts = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "track_id string, part_ord int")
    codes = [r.code for r in normalize.diagnostics(own, parts).orderBy("diagnostic_index").collect()]
    assert codes == ["SOURCE_CONTINUITY_BREAK", "EMPTY_SOURCE_PART", "SOURCE_CONTINUITY_BREAK"]
    gaps = Assessment(own, targets(spark, t=SQUARE), Policy(None), parts).gaps.collect()
    assert [(g.causes, g.diagnostic_indices) for g in gaps] == [(["SOURCE_CONTINUITY_BREAK", "EMPTY_SOURCE_PART"], [0, 1, 2])]


def test_decisions_in_order(spark):
    t = "2024-01-01T00:00:{}Z"
    route = [(0, 0, t.format("00")), (0.001, 0, t.format("10")), (0.002, 0, None), (0.003, 0, t.format("60")), (0.004, 0, t.format("30")), (0.005, 0, t.format("20")), (0.015, 0, t.format("21"))]
    found = [r.decision for r in assess(spark, [route], SQUARE, cap=20.0).decided.orderBy("edge_index").collect()]
    assert found == ["ADMITTED", "SPEED_TIME_MISSING", "SPEED_TIME_MISSING", "SPEED_TIME_UNSUPPORTED", "SPEED_TIME_NONINCREASING", "IMPLIED_SPEED_EXCEEDS_POLICY"]


def test_guard_band_and_long_fractions(spark):
    metres = float(geodesy.inverse_metres(0, 0, 0.001, 0)[0])
    route = [(0, 0, "2024-01-01T00:00:00Z"), (0.001, 0, "2024-01-01T00:00:01Z")]
    decide = lambda cap, r=route: assess(spark, [r], SQUARE, cap=cap).decided.first().decision
    assert decide(metres) == "SPEED_NUMERICALLY_INDETERMINATE"
    assert decide(metres - 1e-5) == "IMPLIED_SPEED_EXCEEDS_POLICY" and decide(metres + 1e-5) == "ADMITTED"
    close = [(0, 0, "2024-01-01T00:00:00.0000000000000000000001Z"), (0, 0, "2024-01-01T00:00:00.0000000000000000000002Z")]
    assert decide(1.0, close) in ("SPEED_NUMERICALLY_INDETERMINATE", "ADMITTED")
    assert decide(1.0, close[::-1]) == "SPEED_TIME_NONINCREASING"


def test_policy_is_explicit():
    for wrong in (0, -1, float("nan"), float("inf"), True, "5"):
        with pytest.raises(ValueError):
            Policy(wrong)


def test_geodesy_witnesses():
    found = geodesy.inverse_metres([0, 0, 0, 0, 7], [0, 0, 90, 0, 8], [1, 180, 0, 179.5, 7], [0, 0, -90, 0.5, 8])
    assert found == pytest.approx([6378137 * 3.141592653589793 / 180, 20003931.458625447, 20003931.458625447, 19936288.578965, 0], abs=1e-6)


def test_numbers_and_times(spark):
    texts = spark.createDataFrame([("1.5",), ("abc",), ("nan",), ("1e999",), ("1e-999",), ("0e-999",), ("1d",), (None,)], "x string")
    codes = [r[0] for r in texts.select(scalars.number_code(F.col("x"))).collect()]
    assert codes == [None, "INVALID_NUMERIC_VALUE", "NONFINITE_NUMERIC_VALUE", "NONFINITE_NUMERIC_VALUE", "NUMERIC_PRECISION_UNREPRESENTABLE", None, "INVALID_NUMERIC_VALUE", None]
    times = spark.createDataFrame([("2024-01-01T00:00:00.5Z",), ("2024-01-01T00:00:60Z",), ("2024-02-30T00:00:00Z",), ("2024-01-01T00:00:00",), (None,)], "t string")
    found = [r[0] for r in times.select(scalars.utc_seconds(F.col("t")).cast("double")).collect()]
    assert found == [1704067200.5, None, None, None, None]
    row = spark.range(1).select(scalars.pace_text(F.lit(3.0)), scalars.speed_bin(F.lit(2.5)), scalars.escape_html(F.lit("<&\">")), scalars.escape_json(F.lit("</a&")), scalars.code_of(F.lit("A: b")), scalars.json_path(F.array(F.lit("0"), F.lit("x")))).first()
    assert tuple(row) == ("5:33", 2, "&lt;&amp;&quot;&gt;", "\\u003c/a\\u0026", "A", '$[0]["x"]')


def test_places_and_digests_on_columns(spark):
    import hashlib
    import math

    box = F.struct(*[F.lit(v).alias(n) for n, v in (("min_x", 0.0), ("min_y", 0.0), ("max_x", 2.0), ("max_y", 1.0))])
    rows = spark.createDataFrame([(0.0, 0.0, 3.0, 1.0, 0.75, 0.25), (1.0, 5.0, 1.5, 1.0, 1.25, 3.0), (0.1, 0.2, 0.1, 0.2, 0.1, 0.2)], "x0 double, y0 double, x1 double, y1 double, x double, y double")
    fraction = scalars.dominant_fraction(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "x", "y")])
    found = rows.select(fraction.alias("f"), scalars.ulp(F.col("x0")).alias("u"), scalars.screen_point(F.col("x"), F.col("y"), box).alias("p"), canonical.digest_of(F.struct("x", "y")).alias("d")).collect()
    assert [r.f for r in found] == [0.25, 0.5, None] and [r.u for r in found] == [math.ulp(v) for v in (0.0, 1.0, 0.1)]
    a, b = found[0].p, found[1].p
    assert (b.x - a.x) / 0.5 == pytest.approx((a.y - b.y) / 2.75) and found[0].p.x == pytest.approx(0.75 * 470)
    assert found[0].d == canonical.value_digest({"x": 0.75, "y": 0.25}) == hashlib.sha256(b'{"x":0.75,"y":0.25}').hexdigest()
    codes = spark.createDataFrame([('{"a":1}',), ("{",)], "t string").select(canonical.strict_json_code(F.col("t")).alias("c")).collect()
    assert codes[0].c is None and codes[1].c


def test_strict_json():
    for text in ('{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', '{"a":1e-999}', '"\\ud800"', "{"):
        with pytest.raises(ValueError):
            canonical.strict_load(text)
    assert canonical.canonical_json(canonical.strict_load('{"b":[1,2.50],"a":1e-7}')) == '{"a":1e-07,"b":[1,2.5]}'


def _line(xs, seconds):
    return [(x, 0, None if s is None else f"2024-01-01T00:00:{s:02d}Z") for x, s in zip(xs, seconds, strict=True)]


def test_metrics(spark):
    a = assess(spark, [_line((0, 0.001, 0.002), (0, 10, 20))], WORLD)
    rows = a.metrics.orderBy("fragment_ordinal").collect()
    assert [r.status for r in rows] == ["valid", "valid"] and all(abs(r.speed_mps - 11.13195) < 0.01 and r.duration_s == 10 and r.screening == "not_screened" for r in rows)
    paused = [(0, 0, "2024-01-01T00:00:00Z"), (0.001, 0, "2024-01-01T00:00:10Z"), (0.001, 0, "2024-01-01T00:00:50Z"), (0.002, 0, "2024-01-01T00:01:00Z")]
    a = assess(spark, [paused], WORLD)
    assert tuple(temporal.metric_counts(a.metrics).select("valid", "unavailable", "stationary").first()) == (2, 0, 1)
    still = a.metrics.filter("stationary").first()
    assert (still.duration_s, still.speed_mps, still.pace_s_per_km) == (40.0, 0.0, None)
    assert {r.status for r in assess(spark, [_line((0, 0.001), (None, None))], WORLD).metrics.collect()} == {"missing_timestamp"}
    assert {r.status for r in assess(spark, [[(179, 0, "2024-01-01T00:00:00Z"), (-179, 0, "2024-01-01T00:01:00Z")]], WORLD).metrics.collect()} == {"planar_dateline_ambiguous"}
    cut = assess(spark, [_line((-1, 3), (0, 40))], polygon(rectangle(0, -1, 2, 1))).metrics.first()
    assert (cut.duration_s, cut.duration_basis) == (20.0, "proportional_parent_edge_allocation")


def test_export_and_map(spark):
    a = assess(spark, [[(-1, 1), (3, 1)], [(4, 1), (5, 1)]], SQUARE)
    row = export.geojson(a, metric_mode="speed_mps").first()
    value = canonical.strict_load(row.geojson)
    layers = [f["properties"]["layer"] for f in value["features"]]
    assert layers == ["target_area", "target_segment", *["observed_outside"] * 3, "gap_endpoint", "gap_endpoint", "target_metric_edge"]
    assert value["metadata"]["relation"] == "partial" and value["features"][1]["geometry"]["coordinates"] == [[0.0, 1.0], [2.0, 1.0]]
    page = mapview.render_map(row.geojson, "a <b>")
    assert "a &lt;b&gt;" in page and page.count("<circle") == 2 and "<b>" not in page
    assert len(value["metadata"]["gaps"]) == 1 and value["metadata"]["stationary"] == [] and value["metadata"]["screening"] == "speed_screening_disabled"
    assert len({f["properties"]["assessment"] for f in value["features"]} | {value["metadata"]["assessment"]}) == 1
    assert "passed: 0, indeterminate: 0, unavailable: 0, not screened: 1, unknown: 0" in page, page[page.index("Speed screening") :][:120]
    assert "from 1.5 m/s" in page and "/km" in page and 'id="reset"' in page
    box = [tuple(map(float, p.split())) for p in page.split('<g id="target_area">')[1].split('d="M ')[1].split(" Z")[0].split(" L ")]
    assert abs((box[1][0] - box[0][0]) - (box[1][1] - box[2][1])) < 0.01  # a square is drawn as one
    style = lambda **about: mapview._style({"layer": "target_metric_edge"} | about)
    assert "dash" not in style(speed_mps=3.0, screening="passed") and all(f'dasharray="{d}"' in x for d, x in ((mapview.UNKNOWN_STATE, style(speed_mps=3.0)), (mapview.UNKNOWN_STATE, style(speed_mps=3.0, screening="odd")), (mapview.NO_SPEED, style(screening="passed"))))
    shown = spark.createDataFrame([(row.geojson,), ("{}",), (None,)], "g string").select(mapview.map_html(F.col("g")).alias("m")).select("m.code").collect()
    assert [r.code for r in shown] == [None, "MAP_INVALID_GEOJSON", "MAP_WITHOUT_GEOJSON"]
    bad = json.loads(row.geojson)
    bad["features"][1]["geometry"] = {"type": "Point", "coordinates": [[0, 0]]}
    with pytest.raises(mapview.MapError, match="MAP_LAYER_GEOMETRY_MISMATCH"):
        mapview.render_map(json.dumps(bad))
    none = export.geojson(assess(spark, [[(1, 1)]], SQUARE)).first()
    assert none.outcome == "produced" and json.loads(none.geojson)["metadata"]["assessable"] is False


def test_target_validation(spark):
    shapes = {
        "good": SQUARE, "hole": polygon(rectangle(0, 0, 4, 4), rectangle(1, 1, 2, 2)), "open": polygon(rectangle(0, 0, 1, 1)[:-1] + [[0, 5]]),
        "bow": polygon([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]), "outer hole": polygon(rectangle(0, 0, 1, 1), rectangle(2, 2, 3, 3)),
        "far": polygon(rectangle(0, 0, 200, 1)), "point": {"type": "Point", "coordinates": [0, 0]},
    }
    found = {r.target_id: r.code for r in areas.target_issues(targets(spark, **shapes)).collect()}
    assert found == {"open": "TARGET_RING_NOT_CLOSED", "bow": "TARGET_TOPOLOGY_INVALID", "outer hole": "TARGET_TOPOLOGY_INVALID", "far": "TARGET_SCHEMA_INVALID", "point": "TARGET_SCHEMA_INVALID"}
    closed = areas.rings_closed(targets(spark, hole=shapes["hole"])).collect()
    assert [(r.ring, r.positions, r.closed) for r in closed] == [(0, 5, True), (1, 5, True)]


def test_invalid_targets_are_refused_pair_by_pair(spark):
    shapes = targets(spark, good=SQUARE, bow=polygon([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]), far=polygon(rectangle(0, 0, 200, 1)))
    a = Assessment(samples(spark, a=[[(-1, 1), (3, 1)]], b=[[(5, 5), (6, 6)]]), shapes, Policy(None))
    told = {(r.track_id, r.target_id): (r.status, r.relation, r.assessable) for r in a.relations.collect()}
    bad = {("a", "bow"): "TARGET_TOPOLOGY_INVALID", ("b", "bow"): "TARGET_TOPOLOGY_INVALID", ("a", "far"): "TARGET_SCHEMA_INVALID", ("b", "far"): "TARGET_SCHEMA_INVALID"}
    assert told == {("a", "good"): ("OK", "partial", True), ("b", "good"): ("OK", "outside", True)} | {k: (v, None, None) for k, v in bad.items()}
    assert {r.target_id for r in a.fragments.select("target_id").distinct().collect()} == {"good"}
    assert {(r.track_id, r.target_id): r.outcome for r in export.geojson(a).collect() if r.geojson is None} == bad


def test_large_targets_are_validated_by_a_sweep():
    import math
    import time

    n = 20_000
    circle = [[10 * math.cos(2 * math.pi * k / n), 10 * math.sin(2 * math.pi * k / n)] for k in range(n)]
    hole = [[0.5 * x, 0.5 * y] for x, y in circle]
    began = time.time()
    assert areas.topology_code(json.dumps(polygon([*circle, circle[0]]))) is None
    assert areas.topology_code(json.dumps(polygon([*circle, circle[0]], [*hole[::40], hole[0]]))) is None
    crossed = [*circle]
    crossed[5], crossed[9000] = circle[9000], circle[5]
    assert areas.topology_code(json.dumps(polygon([*crossed, crossed[0]]))) == "TARGET_TOPOLOGY_INVALID"
    assert time.time() - began < 60
    islands = multi([rectangle(0, 0, 9, 9), rectangle(1, 1, 8, 8)], [rectangle(2, 2, 3, 3)])
    assert areas.topology_code(json.dumps(islands)) is None
    assert areas.topology_code(json.dumps(multi([rectangle(0, 0, 9, 9)], [rectangle(2, 2, 3, 3)]))) == "TARGET_TOPOLOGY_INVALID"
    assert areas.topology_code(json.dumps(polygon(rectangle(0, 0, 9, 9), rectangle(1, 1, 8, 8), rectangle(2, 2, 3, 3)))) == "TARGET_TOPOLOGY_INVALID"


def test_verifiers_accept_and_name_tampering(spark):
    a = assess(spark, [[(-1, 1), (1, 1), (3, 1)], [(1, 1.5), (1.5, 1.5)]], SQUARE)
    from groundtrace.operators.quality import usable_intervals

    usable = usable_intervals(a.decided.drop("run"))
    assert verify.evidence_issues(a.observations, a.diagnostics).isEmpty()
    assert verify.quality_issues(a, usable, a.excluded, a.gaps).isEmpty()
    assert verify.spatial_issues(a, a.fragments, a.relations).isEmpty()
    assert verify.entity_issues(a, a.segments).isEmpty()
    codes = lambda d: {r.code for r in d.collect()}
    assert "EDGE_UNACCOUNTED" in codes(verify.quality_issues(a, usable.filter("part_index = 0"), a.excluded, a.gaps))
    assert "EDGE_CLAIMED_TWICE" in codes(verify.quality_issues(a, usable.unionByName(usable), a.excluded, a.gaps))
    assert "FRAGMENTS_DO_NOT_TILE" in codes(verify.spatial_issues(a, a.fragments.filter("NOT covered"), a.relations))
    wrong = a.relations.withColumn("relation", F.lit("outside"))
    assert codes(verify.spatial_issues(a, a.fragments, wrong)) == {"ASSESSMENT_RELATION_CONTRADICTS_EVIDENCE"}
    assert codes(verify.entity_issues(a, a.segments.filter("ordinal = 0"))) == {"TARGET_COVERAGE_NOT_EXHAUSTIVE"}
    beyond = a.segments.withColumn("end", F.col("end").withField("observation_index", F.lit(9)))
    assert "TRACK_POSITION_OUT_OF_BOUNDS" in codes(verify.entity_issues(a, beyond))
    shifted = a.observations.withColumn("record_index", F.col("record_index") + 1)
    assert codes(verify.evidence_issues(shifted, a.diagnostics)) == {"SOURCE_MAPPING_INVALID"}


def test_streaming_assesses_touched_tracks(spark, tmp_path):
    from groundtrace.streaming.incremental import assess_stream

    whole = samples(spark, a=[[(-1, 1), (1, 1), (3, 1)]], b=[[(0, 0), (1, 1)]])
    source = tmp_path / "in"
    whole.filter("record_index < 2").coalesce(1).write.parquet(str(source))
    seen = {}

    def sink(rows, number):
        seen.update({(number, r.track_id): r.relation for r in rows.collect()})

    def run():
        stream = spark.readStream.schema(whole.schema).parquet(str(source))
        assess_stream(stream, targets(spark, t=SQUARE), Policy(None), str(tmp_path / "table"), str(tmp_path / "checkpoint"), sink).awaitTermination()

    run()
    whole.filter("record_index = 2").coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert seen == {(0, "a"): "partial", (0, "b"): "inside", (1, "a"): "partial"}


def test_schema_rules(spark):
    rows = spark.createDataFrame([(1, 0.5, "x"), (2, float("nan"), ""), (3, -0.0, None)], "id int, v double, s string")
    rules = {("$.v", "number"): scalars.canonical_number(F.col("v")), ("$.s", "minLength"): F.length("s") >= 1}
    found = sorted(tuple(r) for r in verify.schema_issues(rows, rules, "id").collect())
    assert found == [(2, "$.s", "minLength"), (2, "$.v", "number"), (3, "$.s", "minLength"), (3, "$.v", "number")]


def test_work_grows_with_the_parts(spark):
    """Fragmented tracks of 200 to 1600 parts: under 2.8 times the time for each doubling, with room for a busy machine."""
    import time

    taken = []
    for n in (200, 1600):
        a = assess(spark, [[(-1, 1 + k / 10000), (3, 1 + k / 10000), (3, 1.5)] for k in range(n)], SQUARE)
        began = time.time()
        assert a.segments.count() == n
        taken.append(time.time() - began)
    assert taken[1] < taken[0] * 2.8**3
