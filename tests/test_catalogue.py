"""Catalogue queries without SQL: none of the seven targets is left out."""

from groundtrace.plans import catalogue
from groundtrace.sources import targets as areas

SMALL = "/root/testdata/sf0.001"


def test_geojson_and_maps_of_all_targets(spark):
    tracks = {r.track_id for r in catalogue.q01_observations(spark, SMALL).select("track_id").distinct().collect()}
    whole = sorted((t, n) for t in tracks for n in areas.CATALOGUE)
    texts = catalogue.q47_geojson_text(spark, SMALL).collect()
    assert sorted((r.track_id, r.target_id) for r in texts) == whole and {r.outcome for r in texts} == {"produced"}
    maps = catalogue.q48_map_html(spark, SMALL).collect()
    assert sorted((r.track_id, r.target_id) for r in maps) == whole and {r.code for r in maps} == {None}
    spark.catalog.clearCache()


def test_verifier_counts_of_all_targets(spark):
    a = catalogue.assessment(spark, SMALL)
    partial = {r.target_id: r.n for r in a.relations.filter("relation = 'partial'").groupBy("target_id").agg({"*": "count"}).toDF("target_id", "n").collect()}
    lost = {r.target_id: r.n for r in a.segments.filter("ordinal % 2 = 1").select("track_id", "target_id").distinct().groupBy("target_id").agg({"*": "count"}).toDF("target_id", "n").collect()}
    found = {(r.target_id, r.code): r.pairs for r in catalogue.q53_spatial_issues(spark, SMALL).collect()}
    assert {t: n for (t, c), n in found.items() if c == "ASSESSMENT_RELATION_CONTRADICTS_EVIDENCE"} == partial
    assert {t: n for (t, c), n in found.items() if c == "TARGET_COVERAGE_NOT_EXHAUSTIVE"} == lost
    assert set(partial) - {"T1", "T4"} and set(lost) - {"T1", "T4"}
    spark.catalog.clearCache()
