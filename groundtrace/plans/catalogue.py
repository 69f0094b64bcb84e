"""The catalogue of queries over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.functions.geodesy import geodesic_metres
from groundtrace.operators import export, mapview, normalize, quality, relation, temporal, verify
from groundtrace.operators import clip as clipping
from groundtrace.operators import entities as entity
from groundtrace.operators.quality import Policy
from groundtrace.plans.assessment import Assessment
from groundtrace.plans.oracle import CAP, query
from groundtrace.sources import events as event_tracks
from groundtrace.sources import targets as areas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def assessment(spark: SparkSession, sf_dir: str, *names: str, cap: float | None = CAP) -> Assessment:
    return Assessment(event_tracks.samples(spark.read.parquet(f"{sf_dir}/events.parquet")), areas.catalogue(spark, *names), Policy(cap))


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = query(sql)
        return f

    return register


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _span(df: DataFrame) -> DataFrame:
    """``start`` and ``end`` places as plain columns."""
    parts = {f"{e}_{n}": F.col(f"{e}.{c}") for e in ("start", "end") for n, c in (("obs", "observation_index"), ("frac", "fraction_to_next"))}
    return _long(df.withColumns(parts).drop("start", "end"), "start_obs", "end_obs")


def _micros(seconds: str) -> F.Column:
    return F.round(F.col(seconds) * 1_000_000).cast("long")


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, observation_index, record_index, lon, lat, us FROM obs")
def q01_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessment(spark, sf_dir).observations
    return _long(rows, "part_index", "observation_index").select("track_id", "part_index", "observation_index", "record_index", "lon", "lat", _micros("seconds").alias("us"))


@_query("SELECT track_id, diagnostic_index, 'POSITION_MISSING' AS code, record_index, CAST(prev_part AS BIGINT) AS prev_part, prev_obs, CAST(next_part AS BIGINT) AS next_part, next_obs FROM diag")
def q02_diagnostics_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessment(spark, sf_dir).diagnostics
    parts = [F.col(f"{s}.{c}").cast("long").alias(n) for s, c, n in (("previous", "part_index", "prev_part"), ("previous", "observation_index", "prev_obs"), ("next", "part_index", "next_part"), ("next", "observation_index", "next_obs"))]
    return rows.select("track_id", F.col("diagnostic_index").cast("long").alias("diagnostic_index"), "code", "record_index", *parts)


@_query("SELECT track_id, count(DISTINCT part_index) AS parts, count(*) AS observations, count(*) - count(us) AS untimed FROM obs GROUP BY track_id")
def q03_part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment(spark, sf_dir).observations.groupBy("track_id").agg(F.count_distinct("part_index").alias("parts"), F.count("*").alias("observations"), (F.count("*") - F.count("ts_text")).alias("untimed"))


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, edge_index, x0, y0, x1, y1, lineage0, lineage1 FROM edges")
def q04_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.edges(assessment(spark, sf_dir).observations)
    return _long(rows, "part_index", "edge_index", "lineage0", "lineage1").select("track_id", "part_index", "edge_index", "x0", "y0", "x1", "y1", "lineage0", "lineage1")


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, edge_index, x0 AS lon, y0 AS lat FROM edges WHERE x0 = x1 AND y0 = y1")
def q05_stationary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.edges(assessment(spark, sf_dir).observations).filter(quality.stationary())
    return _long(rows, "part_index", "edge_index").select("track_id", "part_index", "edge_index", F.col("x0").alias("lon"), F.col("y0").alias("lat"))


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, edge_index, round(metres, 3) AS metres FROM edges JOIN distances USING (x0, y0, x1, y1)")
def q06_edge_distance_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.edges(assessment(spark, sf_dir).observations)
    metres = geodesic_metres(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return _long(rows, "part_index", "edge_index").select("track_id", "part_index", "edge_index", F.round(metres, 3).alias("metres"))


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, edge_index, decision FROM decided")
def q07_edge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(assessment(spark, sf_dir).decided, "part_index", "edge_index").select("track_id", "part_index", "edge_index", "decision")


@_query("SELECT decision, count(*) AS edges FROM decided GROUP BY decision")
def q08_edge_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment(spark, sf_dir).decided.groupBy("decision").agg(F.count("*").alias("edges"))


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, low, high FROM intervals")
def q09_usable_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(quality.usable_intervals(assessment(spark, sf_dir).decided.drop("run")), "part_index", "low", "high")


@_query("SELECT track_id, excluded_index, CAST(part_index AS BIGINT) AS part_index, edge_index, reason, lineage0, lineage1 FROM excluded")
def q10_excluded_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(assessment(spark, sf_dir).excluded, "excluded_index", "part_index", "edge_index", "lineage0", "lineage1")


def _gap_ends(df: DataFrame) -> DataFrame:
    parts = {f"{e}_{n}": F.col(f"{e}.{c}").cast("long") for e in ("start", "end") for n, c in (("part", "part_index"), ("obs", "observation_index"))}
    return df.withColumns(parts).drop("start", "end")


_ENDS = "CAST(start_part AS BIGINT) AS start_part, CAST(start_obs AS BIGINT) AS start_obs, CAST(end_part AS BIGINT) AS end_part, CAST(end_obs AS BIGINT) AS end_obs"


@_query(f"SELECT track_id, {_ENDS}, causes, diagnostic_indices FROM source_gaps")
def q11_source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gap_ends(quality.source_gaps(assessment(spark, sf_dir).diagnostics))
    return rows.select("track_id", "start_part", "start_obs", "end_part", "end_obs", F.array_join("causes", ",").alias("causes"), F.array_join(F.col("diagnostic_indices").cast("array<string>"), ",").alias("diagnostic_indices"))


@_query(f"SELECT track_id, {_ENDS}, causes, excluded_index FROM quality_gaps")
def q12_quality_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gap_ends(quality.quality_gaps(assessment(spark, sf_dir).excluded))
    return _long(rows, "excluded_index").select("track_id", "start_part", "start_obs", "end_part", "end_obs", F.array_join("causes", ",").alias("causes"), "excluded_index")


@_query(f"SELECT track_id, gap_index, kind, {_ENDS}, causes, diagnostic_indices, excluded_index FROM gaps")
def q13_gaps_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(_gap_ends(assessment(spark, sf_dir).gaps), "gap_index", "excluded_index")
    return rows.withColumns({"causes": F.array_join("causes", ","), "diagnostic_indices": F.array_join(F.col("diagnostic_indices").cast("array<string>"), ",")})


@_query("SELECT track_id, gap_index, kind, -180.0::DOUBLE AS min_lon, -90.0::DOUBLE AS min_lat, 180.0::DOUBLE AS max_lon, 90.0::DOUBLE AS max_lat FROM gaps")
def q14_gap_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir)
    rows = a.gaps.select("track_id", "gap_index", "kind").join(a.constraints, ["track_id", "gap_index"], "left")
    return _long(rows, "gap_index").select("track_id", "gap_index", "kind", "bound.*")


@_query("SELECT track_id, bool_or(x0 <> x1 OR y0 <> y1) AS assessable FROM usable GROUP BY track_id")
def q15_track_assessable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment(spark, sf_dir).usable.groupBy("track_id").agg(F.max(~quality.stationary()).alias("assessable"))


@_query("SELECT track_id, scale, round(length, 6) AS length FROM (SELECT track_id, max(greatest(abs(lon), abs(lat))) AS scale FROM obs GROUP BY 1) JOIN (SELECT track_id, sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS length FROM edges GROUP BY 1) USING (track_id)")
def q16_track_scale_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = assessment(spark, sf_dir).observations
    scale = observed.groupBy("track_id").agg(F.max(F.greatest(F.abs("lon"), F.abs("lat"))).alias("scale"))
    length = quality.edges(observed).groupBy("track_id").agg(F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 6).alias("length"))
    return scale.join(length, "track_id")


@_query("SELECT target_id, CAST(polygon AS BIGINT) AS polygon, CAST(ring AS BIGINT) AS ring, CAST(segment AS BIGINT) AS segment, ax, ay, bx, by, ring > 0 AS is_hole FROM segs")
def q17_ring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(areas.ring_segments(areas.catalogue(spark)), "polygon", "ring", "segment")


@_query("SELECT target_id, CAST(polygon AS BIGINT) AS polygon, CAST(ring AS BIGINT) AS ring, count(*) + 1 AS positions, arg_min(ax, segment) = arg_max(bx, segment) AND arg_min(ay, segment) = arg_max(by, segment) AS closed FROM segs GROUP BY ALL")
def q18_ring_closed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(areas.rings_closed(areas.catalogue(spark)), "polygon", "ring", "positions")


@_query("""SELECT track_id, CAST(part_index AS BIGINT) AS part_index, observation_index, target_id,
    bool_or((bx - ax) * (lat - ay) - (by - ay) * (lon - ax) = 0 AND lon BETWEEN least(ax, bx) AND greatest(ax, bx) AND lat BETWEEN least(ay, by) AND greatest(ay, by))
    OR sum(CASE WHEN (ay > lat) <> (by > lat) AND lon < (bx - ax) * (lat - ay) / nullif(by - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS covered FROM obs , segs GROUP BY ALL""")
def q19_point_in_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir)
    return _long(clipping.covered_points(a.observations, a.targets), "part_index", "observation_index").select("track_id", "part_index", "observation_index", "target_id", "covered")


def _fragments(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return _long(assessment(spark, sf_dir, *names).fragments.drop("status"), "part_index", "edge_index", "fragment")


_FRAGS = "SELECT track_id, target_id, CAST(part_index AS BIGINT) AS part_index, edge_index, CAST(fragment AS BIGINT) AS fragment, lo, hi, covered FROM frags WHERE "


@_query(_FRAGS + "target_id IN ('T1', 'T7')")
def q20_clip_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir, "T1", "T7")


@_query(_FRAGS + "target_id IN ('T2', 'T4')")
def q21_clip_polygon_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir, "T2", "T4")


@_query(_FRAGS + "target_id = 'T3'")
def q22_clip_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir, "T3")


@_query(_FRAGS + "NOT covered")
def q23_outside_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir).filter("NOT covered")


@_query("SELECT target_id, count(*) AS edges, CAST(0 AS BIGINT) AS broken FROM pairs GROUP BY target_id")
def q24_fragment_tiling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.tiling(assessment(spark, sf_dir).fragments).groupBy("target_id").agg(F.count("*").alias("edges"), F.count_if("broken").alias("broken"))


@_query("SELECT track_id, target_id, CAST(part_index AS BIGINT) AS part_index, edge_index, covered FROM still")
def q25_stationary_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(assessment(spark, sf_dir).stationary, "part_index", "edge_index")


@_query("SELECT track_id, target_id, gap_index, kind, classification, true AS unresolved, possible_outside, reason FROM relevance")
def q26_gap_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(assessment(spark, sf_dir).relevance, "gap_index").select("track_id", "target_id", "gap_index", "kind", "classification", "unresolved", "possible_outside", "reason")


@_query("SELECT track_id, target_id, assessable, relation, completeness, reason FROM relations")
def q27_relation_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment(spark, sf_dir).relations.drop("status")


def _segments(a: Assessment) -> DataFrame:
    return _long(_span(a.segments), "ordinal", "part_index", "pieces")


_SEGS = "SELECT track_id, target_id, ordinal, CAST(part_index AS BIGINT) AS part_index, CAST(so AS BIGINT) AS start_obs, sf::DOUBLE AS start_frac, CAST(eo AS BIGINT) AS end_obs, ef::DOUBLE AS end_frac"


@_query(_SEGS + ", pieces FROM segments")
def q28_maximal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(assessment(spark, sf_dir)).drop("run")


@_query("SELECT track_id, target_id, ordinal, CAST(vertex AS BIGINT) AS vertex, x, y FROM vertices")
def q29_segment_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(entity.vertices(assessment(spark, sf_dir).placed), "ordinal", "vertex")


@_query("SELECT track_id, target_id, ordinal, round(sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))), 6) AS length_deg FROM ends GROUP BY ALL")
def q30_segment_length_deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.round(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), 6)
    return _long(assessment(spark, sf_dir).placed.groupBy("track_id", "target_id", "ordinal").agg(length.alias("length_deg")), "ordinal")


@_query("""SELECT track_id, target_id, count(*) AS segments, count(*) FILTER (next_start IS NOT NULL AND next_start <= own_end) AS overlapping FROM (
    SELECT track_id, target_id, part_index * 1000000.0 + eo + ef AS own_end, lead(part_index * 1000000.0 + so + sf) OVER (PARTITION BY track_id, target_id ORDER BY ordinal) AS next_start FROM segments ) GROUP BY ALL""")
def q31_segments_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("track_id", "target_id").orderBy("ordinal")
    rows = assessment(spark, sf_dir).segments.withColumn("next", F.lead("start").over(order))
    return rows.groupBy("track_id", "target_id").agg(F.count("*").alias("segments"), F.count_if(F.col("next") <= F.col("end")).alias("overlapping"))


@_query("SELECT track_id, target_id, gap_index, kind, causes, classification, reason AS relevance FROM relevance")
def q32_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessment(spark, sf_dir).uncertainties.withColumn("causes", F.array_join("causes", ",")).drop("start", "end")
    return _long(rows, "gap_index")


@_query("SELECT count(*) AS assessments, count(*) FILTER (relation IS NULL) AS without, CAST(0 AS BIGINT) AS contradictions FROM relations")
def q33_assessment_rules_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir).persist()
    broken = relation.assessment_rules(a.relations, a.uncertainties, a.segments).agg(F.count("*").alias("contradictions"))
    return a.relations.agg(F.count("*").alias("assessments"), F.count_if(F.col("relation").isNull()).alias("without")).crossJoin(broken)


@_query("""SELECT track_id, target_id, ordinal, CAST(fragment_ordinal AS BIGINT) AS fragment_ordinal, status, CASE WHEN status = 'valid' THEN dt END AS duration_s,
    round(CASE WHEN status = 'valid' THEN metres END, 3) AS distance_m, round(CASE WHEN status = 'valid' THEN metres / dt END, 6) AS speed_mps,
    CASE WHEN f0 = 0 AND f1 = 1 THEN 'observed_parent_endpoints' ELSE 'proportional_parent_edge_allocation' END AS duration_basis, screening FROM metrics WHERE NOT stationary""")
def q34_metric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(assessment(spark, sf_dir).metrics.filter("NOT stationary"), "ordinal", "fragment_ordinal")
    numbers = [F.round(n, d).alias(n) for n, d in (("distance_m", 3), ("speed_mps", 6))]
    return rows.select("track_id", "target_id", "ordinal", "fragment_ordinal", "status", "duration_s", *numbers, "duration_basis", "screening")


@_query("""SELECT track_id, target_id, count(*) FILTER (NOT stationary AND status = 'valid') AS valid, count(*) FILTER (NOT stationary AND status <> 'valid') AS unavailable,
    count(*) FILTER (stationary) AS stationary FROM metrics GROUP BY track_id, target_id""")
def q35_metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.metric_counts(assessment(spark, sf_dir).metrics)


@_query("""SELECT track_id, target_id, count(*) FILTER (screening = 'passed') AS passed, count(*) FILTER (screening = 'indeterminate') AS indeterminate,
    count(*) FILTER (screening = 'unavailable') AS unavailable, CAST(0 AS BIGINT) AS not_screened FROM metrics WHERE NOT stationary GROUP BY track_id, target_id""")
def q36_speed_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.screening_counts(assessment(spark, sf_dir).metrics)


@_query("""SELECT target_id, CAST(CASE WHEN v < 1.5 THEN 0 WHEN v < 2.5 THEN 1 WHEN v < 3.5 THEN 2 WHEN v < 4.5 THEN 3 ELSE 4 END AS BIGINT) AS bin, count(*) AS edges
    FROM (SELECT target_id, metres / dt AS v FROM metrics WHERE status = 'valid' AND NOT stationary) GROUP BY ALL""")
def q37_speed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessment(spark, sf_dir).metrics.filter("status = 'valid' AND NOT stationary")
    return rows.groupBy("target_id", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("edges"))


@_query("SELECT track_id, target_id, ordinal, CAST(fragment_ordinal AS BIGINT) AS fragment_ordinal, status, CASE WHEN status = 'valid' THEN dt END AS duration_s, CASE WHEN status = 'valid' THEN 0.0::DOUBLE END AS speed_mps FROM metrics WHERE stationary")
def q38_stationary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(assessment(spark, sf_dir).metrics.filter("stationary"), "ordinal", "fragment_ordinal")
    return rows.select("track_id", "target_id", "ordinal", "fragment_ordinal", "status", "duration_s", "speed_mps")


@_query("""SELECT g.track_id, gap_index, kind, side, CAST(part_index AS BIGINT) AS part_index, observation_index, lon, lat FROM (
    SELECT track_id, gap_index, kind, 'start' AS side, start_part AS p, start_obs AS o FROM gaps WHERE start_part IS NOT NULL UNION ALL SELECT track_id, gap_index, kind, 'end', end_part, end_obs FROM gaps WHERE end_part IS NOT NULL) g
    JOIN obs ON g.track_id = obs.track_id AND g.p = obs.part_index AND g.o = obs.observation_index""")
def q39_gap_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir)
    return _long(export.gap_endpoints(a.gaps, a.observations), "gap_index", "part_index", "observation_index")


@_query("""SELECT target_id, layer, count(*) AS features FROM (
    SELECT target_id, 'target_area' AS layer FROM relations UNION ALL SELECT target_id, 'target_segment' FROM segments UNION ALL SELECT target_id, 'observed_outside' FROM frags WHERE NOT covered
    UNION ALL SELECT target_id, 'gap_endpoint' FROM relevance WHERE start_part IS NOT NULL UNION ALL SELECT target_id, 'gap_endpoint' FROM relevance WHERE end_part IS NOT NULL
    UNION ALL SELECT target_id, 'target_metric_edge' FROM metrics WHERE NOT stationary) GROUP BY ALL""")
def q40_features_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.features(assessment(spark, sf_dir).persist(), metric_mode="speed_mps")
    return rows.groupBy("target_id", "layer").agg(F.count("*").alias("features"))


@_query("""SELECT track_id, target_id, least(a, p) AS min_x, least(b, q) AS min_y, greatest(c, r) AS max_x, greatest(d, s) AS max_y FROM (
    SELECT track_id, target_id, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM vertices GROUP BY ALL) JOIN (SELECT target_id, min(ax) AS p, min(ay) AS q, max(ax) AS r, max(ay) AS s FROM segs GROUP BY 1) USING (target_id)""")
def q41_map_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir)
    return export.extents(entity.geometries(a.placed), a.targets)


@_query("SELECT count(*) AS edges, CAST(0 AS BIGINT) AS unclaimed, CAST(0 AS BIGINT) AS claimed_twice FROM edges")
def q42_edge_partition_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir)
    usable = quality.usable_intervals(a.decided.drop("run"))
    lost = verify.unclaimed_edges(a.decided, usable, a.excluded).agg(F.count("*").alias("unclaimed"))
    twice = verify.repeated_claims(usable, a.excluded).agg(F.count("*").alias("claimed_twice"))
    return a.decided.agg(F.count("*").alias("edges")).crossJoin(lost).crossJoin(twice)


@_query("SELECT track_id, count(*) AS records, max(record_index) + 1 = count(DISTINCT record_index) AS complete FROM samples GROUP BY track_id")
def q43_mapping_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir)
    rows = a.observations.select("track_id", "record_index").unionByName(a.diagnostics.select("track_id", "record_index"))
    return rows.groupBy("track_id").agg(F.count("*").alias("records"), (F.max("record_index") + 1 == F.count_distinct("record_index")).alias("complete"))


@_query("SELECT count(*) AS segments, CAST(0 AS BIGINT) AS without_assessment, CAST(0 AS BIGINT) AS without_target FROM segments")
def q44_reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessment(spark, sf_dir).persist()
    keys = ["track_id", "target_id"]
    one = a.segments.join(a.relations, keys, "left_anti").agg(F.count("*").alias("without_assessment"))
    two = a.segments.join(a.targets, "target_id", "left_anti").agg(F.count("*").alias("without_target"))
    return a.segments.agg(F.count("*").alias("segments")).crossJoin(one).crossJoin(two)


@_query("SELECT track_id, code FROM (SELECT DISTINCT track_id FROM intervals WHERE track_id % 3 = 0), (VALUES ('EDGE_UNACCOUNTED'), ('USABLE_INTERVALS_MISMATCH')) AS v(code)")
def q45_claims_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable intervals from which every third track's first one is taken away: the verifier names just these tracks."""
    a = assessment(spark, sf_dir).persist("decided", "gaps")
    true = quality.usable_intervals(a.decided.drop("run"))
    first = true.groupBy("track_id").agg(F.min(F.struct("part_index", "low")).alias("m")).filter("track_id % 3 = 0").select("track_id", "m.part_index", "m.low")
    claimed = true.join(first, ["track_id", "part_index", "low"], "left_anti").select("track_id", "part_index", "low", "high")
    return verify.quality_issues(a, claimed, a.excluded, a.gaps)


@_query("""SELECT track_id, sha256(string_agg(part_index || ':' || observation_index || ':' || CAST(CAST(lon * 8 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(lat * 8 AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(us AS VARCHAR), ''), '|' ORDER BY part_index, observation_index)) AS track_sha256
    FROM obs GROUP BY track_id""")
def q46_track_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    grid = [(F.col(c) * 8).cast("long") for c in ("lon", "lat")]
    line = F.concat_ws(":", *[text(c) for c in (F.col("part_index"), F.col("observation_index"), *grid, _micros("seconds"))])
    rows = assessment(spark, sf_dir).observations.select("track_id", F.struct("part_index", "observation_index", line.alias("line")).alias("o"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["line"]), "|")
    return rows.groupBy("track_id").agg(F.sha2(whole, 256).alias("track_sha256"))


@_query()
def q47_geojson_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.geojson(assessment(spark, sf_dir).persist(), metric_mode="speed_mps")


@_query()
def q48_map_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.geojson(assessment(spark, sf_dir).persist(), metric_mode="pace_s_per_km")
    return rows.select("track_id", "target_id", mapview.map_html(F.col("geojson")).alias("map")).select("track_id", "target_id", "map.*")


def _gpx_text() -> F.Column:
    """A track point of an observation."""
    return F.format_string('<trkpt lat="%s" lon="%s">%s</trkpt>', F.col("lat").cast("string"), F.col("lon").cast("string"), F.coalesce(F.concat(F.lit("<time>"), "ts_text", F.lit("</time>")), F.lit("")))


def _gpx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, kind, content): every track written as a GPX document, a segment for each part."""
    rows = assessment(spark, sf_dir).observations.withColumn("point", _gpx_text())
    parts = rows.groupBy("track_id", "part_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("observation_index", "point"))), lambda p: p["point"]), "").alias("points"))
    segments = F.transform(F.array_sort(F.collect_list(F.struct("part_index", "points"))), lambda s: F.concat(F.lit("<trkseg>"), s["points"], F.lit("</trkseg>")))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="groundtrace"><trk>'
    files = parts.groupBy("track_id").agg(F.concat(F.lit(head), F.array_join(segments, ""), F.lit("</trk></gpx>")).alias("text"))
    return files.select(F.col("track_id").cast("string").alias("source_id"), F.lit("gpx").alias("kind"), F.col("text").cast("binary").alias("content"))


@_query("SELECT track_id, CAST(part_index AS BIGINT) AS part_index, observation_index, lon, lat, us FROM obs")
def q49_gpx_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track written as a GPX document and read back by the ingestion."""
    from groundtrace.sources.files import ingest

    read = normalize.observations(ingest(_gpx_files(spark, sf_dir)).samples)
    return _long(read, "track_id", "part_index", "observation_index").select("track_id", "part_index", "observation_index", "lon", "lat", _micros("seconds").alias("us"))


@_query("""SELECT CAST(track_id AS VARCHAR) AS track_id, CAST(part_index AS BIGINT) AS part_index, observation_index, record_index,
    CAST(round_even(lon * 2147483648 / 180, 0) AS BIGINT) AS lon_semicircles, CAST(round_even(lat * 2147483648 / 180, 0) AS BIGINT) AS lat_semicircles, us // 1000000 AS s FROM obs""")
def q50_fit_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track written as a FIT activity and read back by the ingestion: semicircles and whole seconds."""
    from groundtrace.sources.files import ingest
    from groundtrace.sources.fitwriter import fit_files

    rows = normalize.observations(ingest(fit_files(assessment(spark, sf_dir).samples)).samples)
    places = [F.rint(F.col(c) * 2**31 / 180).cast("long").alias(f"{c}_semicircles") for c in ("lon", "lat")]
    return _long(rows, "part_index", "observation_index", "record_index").select("track_id", "part_index", "observation_index", "record_index", *places, F.col("seconds").cast("long").alias("s"))


@_query("""SELECT p.track_id || '/' || p.run AS track_id, target_id, i OR o AS assessable, CASE WHEN NOT (i OR o) THEN NULL WHEN i AND o THEN 'partial' WHEN i THEN 'inside' ELSE 'outside' END AS relation,
    CASE WHEN i OR o THEN 'complete' END AS completeness FROM (
    SELECT n.track_id, n.run, n.target_id, coalesce(bool_or(covered), false) AS i, coalesce(bool_or(NOT covered), false) AS o
    FROM (SELECT DISTINCT o.track_id, o.part_index, (SELECT count(*) FROM samples s WHERE s.track_id = o.track_id AND NOT s.positioned AND s.event_id < o.event_id) AS run, target_id FROM obs o , names) n
    LEFT JOIN frags f ON f.track_id = n.track_id AND f.part_index = n.part_index AND f.target_id = n.target_id GROUP BY ALL) p""")
def q51_part_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a track of its own, without a speed cap: no gaps, so that inside and outside are proven."""
    samples = event_tracks.part_samples(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return Assessment(samples, areas.catalogue(spark), Policy(None)).relations.drop("status", "reason")


ORACLE_SQL["q51_part_relations"] = ORACLE_SQL["q51_part_relations"].replace("FROM usable, names", "FROM runs, names")


@_query()
def q52_evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifier counts: none on what the stages give, and the codes for tampered observations."""
    a = assessment(spark, sf_dir).persist("decided")
    tampered = a.observations.withColumn("record_index", F.when((F.col("part_index") == 1) & (F.col("observation_index") == 0), -1).otherwise(F.col("record_index")))
    found = [verify.evidence_issues(a.observations, a.diagnostics).withColumn("claim", F.lit("as produced")), verify.evidence_issues(tampered, a.diagnostics).withColumn("claim", F.lit("tampered"))]
    return found[0].unionByName(found[1]).groupBy("claim", "code").agg(F.count("*").alias("tracks"))


@_query()
def q53_spatial_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial and entity verifiers on claims with every segment's second half and every partial relation taken away."""
    a = assessment(spark, sf_dir).persist()
    relations = a.relations.withColumn("relation", F.when(F.col("relation") == "partial", "inside").otherwise(F.col("relation")))
    segments = a.segments.filter("ordinal % 2 = 0")
    return verify.spatial_issues(a, a.fragments, relations).unionByName(verify.entity_issues(a, segments)).groupBy("target_id", "code").agg(F.count("*").alias("pairs"))


#: Targets beside the valid ones: a ring that crosses itself, one out of the domain, one that isn't closed, a hole beside its polygon.
REFUSED = {
    "X1": ({"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]]}, "TARGET_TOPOLOGY_INVALID"),
    "X2": ({"type": "Polygon", "coordinates": [[[0, 0], [200, 0], [200, 1], [0, 0]]]}, "TARGET_SCHEMA_INVALID"),
    "X3": ({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}, "TARGET_RING_NOT_CLOSED"),
    "X4": ({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]], [[2, 2], [3, 2], [3, 3], [2, 2]]]}, "TARGET_TOPOLOGY_INVALID"),
}


@_query(f"""SELECT track_id, target_id, 'OK' AS status, relation FROM relations
    UNION ALL SELECT track_id, target_id, status, NULL FROM (SELECT DISTINCT track_id FROM obs), (VALUES {", ".join(f"('{n}', '{code}')" for n, (_, code) in REFUSED.items())}) AS v(target_id, status)""")
def q54_target_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid targets together: an invalid one has its code as the outcome of every pair, the others are told as ever."""
    bad = spark.createDataFrame([(n, json.dumps(shape)) for n, (shape, _) in REFUSED.items()], "target_id string, geometry string")
    a = assessment(spark, sf_dir)
    a.given = a.given.unionByName(bad)
    return a.relations.select("track_id", "target_id", "status", "relation")


@_query("""SELECT r.track_id, r.target_id, relation, completeness, 1 AS areas, coalesce(s.n, 0) AS segments, coalesce(o.n, 0) AS outside, coalesce(g.ends, 0) AS gap_ends, coalesce(m.moving, 0) AS metrics,
    coalesce(g.gaps, 0) AS gaps, coalesce(m.still, 0) AS stationary, coalesce(m.passed, 0) AS passed FROM relations r
    LEFT JOIN (SELECT track_id, target_id, count(*) AS n FROM segments GROUP BY ALL) s USING (track_id, target_id) LEFT JOIN (SELECT track_id, target_id, count(*) AS n FROM frags WHERE NOT covered GROUP BY ALL) o USING (track_id, target_id)
    LEFT JOIN (SELECT track_id, target_id, count(*) AS gaps, count(start_part) + count(end_part) AS ends FROM relevance GROUP BY ALL) g USING (track_id, target_id)
    LEFT JOIN (SELECT track_id, target_id, count(*) FILTER (NOT stationary) AS moving, count(*) FILTER (stationary) AS still, count(*) FILTER (NOT stationary AND screening = 'passed') AS passed FROM metrics GROUP BY ALL) m USING (track_id, target_id)""")
def q55_geojson_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exported texts hold, read back from them: features by layer, the relation, and the lists of the metadata."""
    text = F.from_json("geojson", "features array<struct<properties: struct<layer: string>>>, metadata struct<relation: string, completeness: string, gaps: array<string>, stationary: array<string>, screening_counts: struct<passed: bigint>>")
    rows = q47_geojson_text(spark, sf_dir).select("track_id", "target_id", text.alias("t"))
    layer = lambda name: F.size(F.filter("t.features", lambda f: f["properties"]["layer"] == name)).cast("long")
    counts = {"areas": "target_area", "segments": "target_segment", "outside": "observed_outside", "gap_ends": "gap_endpoint", "metrics": "target_metric_edge"}
    lists = [F.size(f"t.metadata.{n}").cast("long").alias(n) for n in ("gaps", "stationary")] + [F.coalesce("t.metadata.screening_counts.passed", F.lit(0).cast("long")).alias("passed")]
    return rows.select("track_id", "target_id", "t.metadata.relation", "t.metadata.completeness", *[layer(v).alias(k) for k, v in counts.items()], *lists)


@_query("SELECT CAST(track_id AS VARCHAR) AS source_id, 1 AS tracks, count(DISTINCT part_index) AS segments, count(*) AS points, count(us) AS times FROM obs GROUP BY track_id")
def q56_gpx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks, segments, points and times of the written GPX documents, counted without the parser."""
    from groundtrace.sources.gpx import gpx_counts

    counts = gpx_counts(_gpx_files(spark, sf_dir))
    return counts.withColumn("tracks", F.col("tracks").cast("int"))
