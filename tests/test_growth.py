"""What work is done once, and how much of it a Python worker holds at a time."""

import json

import pyarrow as pa
from helpers import assess, polygon, rectangle

from groundtrace.functions.canonical import canonical_json
from groundtrace.operators import export, quality, verify
from groundtrace.plans import catalogue
from groundtrace.sources import fit

SMALL = "/root/testdata/sf0.001"
SQUARE = polygon(rectangle(0, 0, 2, 2))
TIMED = [[(-1, 1, "2024-01-01T00:00:00Z"), (1, 1, "2024-01-03T00:00:00Z"), None, (1, 1.5, "2024-01-04T00:00:00Z"), (1, 1.5, "2024-01-04T00:00:10Z"), (3, 1.5)]]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_the_decision_takes_one_python_call(spark):
    a = assess(spark, TIMED, SQUARE, cap=10.0)
    assert plan(quality.excluded_intervals(a.decided)).count("ArrowEvalPython") == 1
    assert plan(a.usable).count("ArrowEvalPython") == 1


def test_fragments_are_clipped_once_for_the_tiling_check(spark):
    assert plan(catalogue.q24_fragment_tiling_check(spark, SMALL)).count("MapInArrow") == 1


def test_a_difference_reads_each_table_once_and_counts_repeats(spark):
    one, two = spark.createDataFrame([(1, None), (1, None), (2, 5), (3, 1)], "track_id int, v int"), spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, 1)], "v_id int, v int").withColumnRenamed("v_id", "track_id")
    found = verify.differences(one, two, "CODE")
    assert plan(found).count("LogicalRDD") + plan(found).count("LocalRelation") == 2
    assert {tuple(r) for r in found.collect()} == {(1, "CODE"), (4, "CODE")}


def test_features_never_pass_through_python_as_a_list(spark):
    a = assess(spark, TIMED, SQUARE, cap=10.0)
    text = export.geojson(a, metric_mode="speed_mps")
    assert "features#" not in "".join(line for line in plan(text).splitlines() if "ArrowEvalPython" in line)
    row = text.first()
    value = json.loads(row.geojson)
    assert canonical_json(value) == row.geojson
    layers = [f["properties"]["layer"] for f in value["features"]]
    assert layers == sorted(layers, key=export.LAYERS.index) and set(layers) == set(export.LAYERS)
    assert [r.layer for r in export.features(a, metric_mode="speed_mps").orderBy("layer_rank", "place").collect()] == layers
    still = value["metadata"]["stationary"]
    assert [s["duration_s"] for s in still] == [10.0] and value["metadata"]["metric_counts"]["stationary"] == 1


def test_files_are_python_objects_in_small_numbers(monkeypatch):
    monkeypatch.setattr(fit, "FILES_AT_ONCE", 2)
    seen = []

    def work(some):
        seen.append(len(some))
        return pa.array([v * 2 for v in some], pa.int64())

    assert fit.in_parts(pa.array([1, 2, 3, 4, 5]), work, pa.int64()).to_pylist() == [2, 4, 6, 8, 10]
    assert seen == [2, 2, 1] and fit.in_parts(pa.array([], pa.int64()), work, pa.int64()).to_pylist() == []


def test_a_file_is_decoded_once(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"))], "source_id string, content binary")
    failures, samples = fit.parse_fit(files)
    assert plan(samples).count("read(content") == 1 and plan(failures).count("read(content") == 1
    assert [tuple(r) for r in failures.collect()] == [("a", "MALFORMED_SOURCE")]
