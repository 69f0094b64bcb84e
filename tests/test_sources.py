"""GPX and FIT bytes to tracks."""

import struct

import pytest

from groundtrace.operators import normalize
from groundtrace.sources import fit, fitwriter
from groundtrace.sources.files import ingest, read_files

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="t">'
POINTS = '<trkpt lat="28.2" lon="112.9"><ele>5</ele><time>2024-01-01T08:00:00+08:00</time></trkpt><trkpt lat="28.3" lon="113"><time>2024-01-01T00:00:10.123456789Z</time></trkpt>'
FIT_TIME = 1704067200 - fit.EPOCH


def _ingest(spark, *files):
    rows = [(f"s{k}", kind, bytearray(data.encode() if isinstance(data, str) else data)) for k, (kind, data) in enumerate(files)]
    return ingest(spark.createDataFrame(rows, "source_id string, kind string, content binary"))


def _codes(found):
    return {r.source_id: (r.outcome, r.code) for r in found.outcomes.collect()}


def test_gpx(spark):
    found = _ingest(spark, ("gpx", f"{HEAD}<!-- <rte> --><trk><trkseg>{POINTS}</trkseg><trkseg/><trkseg>{POINTS}</trkseg></trk></gpx>"))
    assert _codes(found) == {"s0": ("success", None)}
    rows = normalize.observations(found.samples).orderBy("lineage_index").collect()
    assert [(r.part_index, r.record_index, r.lon, r.altitude_m, r.ts_text) for r in rows][:2] == [(0, 0, 112.9, 5.0, "2024-01-01T00:00:00Z"), (0, 1, 113.0, None, "2024-01-01T00:00:10.123456789Z")]
    assert [r.code for r in normalize.diagnostics(found.samples, found.parts).orderBy("diagnostic_index").collect()] == ["SOURCE_CONTINUITY_BREAK", "EMPTY_SOURCE_PART", "SOURCE_CONTINUITY_BREAK"]


@pytest.mark.parametrize(
    "text, code",
    [
        (HEAD + "<trk><trkseg>", "MALFORMED_SOURCE"),
        ('<!DOCTYPE gpx [<!ENTITY a "b">]>' + HEAD[38:] + "</gpx>", "UNSUPPORTED_GPX_DTD"),
        ("<kml></kml>", "INVALID_GPX_STRUCTURE"),
        (HEAD.replace("1.1\" c", "1.0\" c") + f"<trk><trkseg>{POINTS}</trkseg></trk></gpx>", "INVALID_GPX_STRUCTURE"),
        (HEAD + '<trk><trkseg><trkpt lat="1" lon="180"/></trkseg></trk></gpx>', "INVALID_GPX_STRUCTURE"),
        (HEAD + '<trk><trkseg><trkpt lat="91" lon="0"/></trkseg></trk></gpx>', "INVALID_GPX_STRUCTURE"),
        (HEAD + '<wpt lat="1" lon="1"/></gpx>', "UNSUPPORTED_GPX_ROUTE_OR_WAYPOINT"),
        (HEAD + '<trk><trkseg><trkpt lat="0.' + "0" * 400 + '1" lon="0"/></trkseg></trk></gpx>', "NUMERIC_PRECISION_UNREPRESENTABLE"),
    ],
)
def test_gpx_refused(spark, text, code):
    assert _codes(_ingest(spark, ("gpx", text))) == {"s0": ("failure", code)}


def _degrees(lon, lat):
    return round(lat / fit.SEMICIRCLE if hasattr(fit, "SEMICIRCLE") else lat * 2**31 / 180), round(lon * 2**31 / 180)


def test_fit(spark):
    lat, lon = _degrees(112.9, 28.2)
    data = fitwriter.activity([(FIT_TIME, lat, lon), (FIT_TIME + 10, None, None), (FIT_TIME + 20, lat + 9, lon), (5, lat, lon)])
    found = _ingest(spark, ("fit", data), ("fit", fitwriter.activity([(FIT_TIME, lat, lon)], big=True)), ("fit", fitwriter.activity([(1, None, None)])))
    assert _codes(found) == {"s0": ("success", None), "s1": ("success", None), "s2": ("no_positioned_observations", None)}
    rows = normalize.observations(found.samples.filter("track_id = 's0'")).orderBy("lineage_index").collect()
    assert [(r.part_index, r.record_index, r.ts_text) for r in rows] == [(0, 0, "2024-01-01T00:00:00Z"), (1, 2, "2024-01-01T00:00:20Z"), (1, 3, None)]
    assert abs(rows[0].lon - 112.9) < 1e-7 and abs(rows[0].lat - 28.2) < 1e-7
    said = [(r.code, r.record_index) for r in normalize.diagnostics(found.samples.filter("track_id = 's0'")).orderBy("diagnostic_index").collect()]
    assert said == [("POSITION_INVALID_SENTINEL", 1), ("TIMESTAMP_RELATIVE", 3)]


def test_fit_refused(spark):
    good = fitwriter.activity([(FIT_TIME, 1, 1)])
    flipped = good[:-1] + bytes([good[-1] ^ 1])
    no_id = fitwriter.wrapped(fitwriter.definition(1, fit.RECORD, fitwriter.RECORD_LAYOUT) + struct.pack("<BIii", 1, FIT_TIME, 1, 1))
    course = fitwriter.wrapped(fitwriter.definition(0, fit.FILE_ID, [(0, 1, 0)]) + bytes([0, 6]))
    far = fitwriter.activity([(FIT_TIME, 2**30 + 5, 1)])
    files = [("fit", good[:20]), ("fit", flipped), ("fit", no_id), ("fit", course), ("fit", good + good), ("fit", far), ("kml", good), ("fit", fitwriter.wrapped(b""))]
    codes = [c for _, (_, c) in sorted(_codes(_ingest(spark, *files)).items())]
    assert codes == ["MALFORMED_SOURCE", "FIT_CRC_MISMATCH", "FIT_FILE_ID_MISSING", "UNSUPPORTED_FIT_FILE_TYPE", "UNSUPPORTED_FIT_MULTIPLE_FILES", "POSITION_OUT_OF_RANGE", "UNSUPPORTED_SOURCE_KIND", "FIT_FILE_ID_MISSING"]


def test_budget_and_digest(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(f"{HEAD}<trk><trkseg>{POINTS}</trkseg></trk></gpx>")
    (tmp_path / "b.fit").write_bytes(fitwriter.activity([(FIT_TIME, 1, 1)]) + b"x" * 4000)
    rows = read_files(spark, str(tmp_path), 2000)
    found = {r.source_id[-5:]: (r.outcome, r.code, r.content_sha256 is None) for r in ingest(rows).outcomes.collect()}
    assert found == {"a.gpx": ("success", None, False), "b.fit": ("failure", "SOURCE_BYTES_LIMIT_EXCEEDED", True)}
    from pyspark.sql import functions as F

    wrong = ingest(rows.filter("kind = 'gpx'").withColumn("expected_sha256", F.lit("0" * 64)))
    assert [r.code for r in wrong.outcomes.collect()] == ["SOURCE_HASH_MISMATCH"]
    with pytest.raises(ValueError):
        read_files(spark, str(tmp_path), 0)


def test_message_counts(spark):
    data = fitwriter.activity([(FIT_TIME, 1, 1), (FIT_TIME, 2, 2)])
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(bytearray(data),), (bytearray(b"x"),)], "content binary").select(fit.message_counts(F.col("content"))).collect()
    assert [r[0] for r in rows] == [{fit.FILE_ID: 1, fit.RECORD: 2}, None]


def test_target_documents(spark, tmp_path):
    import json

    from groundtrace.sources import targets

    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1.5], [0, 0]]]}
    (tmp_path / "a.json").write_text(json.dumps({"id": "t", "revision_id": "1", "geometry": shape, "definition_provenance": {"description": "d"}}, indent=1))
    row = targets.read_targets(spark, str(tmp_path)).first()
    assert (row.target_id, row.revision_id, json.loads(row.geometry)) == ("t", "1", shape)
    assert targets.ring_segments(targets.read_targets(spark, str(tmp_path))).count() == 3
