"""How a track relates to a target: gap relevance, the four-state relation and the completeness of coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.operators.quality import WORLD
from groundtrace.sources.targets import prepared, shared_ids

WORLD_AREA = (WORLD[2] - WORLD[0]) * (WORLD[3] - WORLD[1])


def _ring_area(ring: Column) -> Column:
    twice = F.aggregate(ring, F.lit(0.0), lambda a, s: a + (s["ax"] * s["by"] - s["bx"] * s["ay"]))
    return F.abs(twice) / 2


def world_relation(targets: DataFrame) -> DataFrame:
    """(target_id, bound_relation): the whole domain, the only bound that gaps can have, against each target.

    A valid target lies in the domain, so it covers the domain exactly if it has its area, and is never apart.
    """
    rows = prepared(targets)

    def net(polygon: Column) -> Column:
        holes = F.transform(F.slice(polygon, F.lit(2), F.size(polygon)), _ring_area)
        return _ring_area(polygon[0]) - F.aggregate(holes, F.lit(0.0), lambda a, v: a + v)

    area = F.aggregate(F.transform("polys", net), F.lit(0.0), lambda a, v: a + v)
    return rows.select("target_id", F.when(area == WORLD_AREA, "covered").otherwise("intersects").alias("bound_relation"))


def gap_relevance(gaps: DataFrame, constraints: DataFrame, targets: DataFrame) -> DataFrame:
    """Each gap of a track against each target."""
    bounded = constraints.select("track_id", "gap_index", F.lit(True).alias("bounded"))
    rows = gaps.join(bounded, ["track_id", "gap_index"], "left").crossJoin(shared_ids(world_relation(targets)))
    relation = F.when(F.col("bounded"), F.col("bound_relation")).otherwise("unavailable")
    rows = rows.withColumn("classification", relation).drop("bounded", "bound_relation")
    unresolved = F.col("classification") != "disjoint"
    named = F.when(F.col("kind") == "source_gap", "SOURCE_GAP_TARGET_UNRESOLVED").otherwise("QUALITY_GAP_TARGET_UNRESOLVED")
    return rows.withColumns({"unresolved": unresolved, "possible_outside": F.col("classification") != "covered", "reason": F.when(unresolved, named).otherwise("GAP_BOUND_DISJOINT")})


def relations(tracks: DataFrame, fragments: DataFrame, gaps: DataFrame, constraints: DataFrame, targets: DataFrame) -> DataFrame:
    """(track_id, target_id, status, assessable, relation, completeness, reason) of each of ``tracks`` (track_id) with each valid target.

    ``fragments`` are those of usable edges. A pair one edge of which can't be told exactly has that edge's status
    and nothing else: the first one in the order of the track. Gaps are folded to two facts a track before they meet
    targets: a gap is relevant unless its bound is apart, and the only bound, the whole domain, never is.
    """
    bounded = constraints.select("track_id", "gap_index", F.lit(True).alias("bounded"))
    open_ = gaps.join(bounded, ["track_id", "gap_index"], "left").groupBy("track_id").agg(F.lit(True).alias("relevant"), F.max(F.col("bounded").isNull()).alias("unbounded"), F.max(F.coalesce("bounded", F.lit(False))).alias("bounded"))
    known = tracks.select("track_id").distinct().join(open_, "track_id", "left")
    pairs = known.crossJoin(shared_ids(world_relation(targets)))
    facts = fragments.groupBy("track_id", "target_id").agg(
        F.max("covered").alias("inside"),
        F.max(~F.col("covered")).alias("outside"),
        F.min(F.when(F.col("status") != "OK", F.struct("part_index", "edge_index", "status"))).alias("failed"),
    )
    rows = pairs.join(facts, ["track_id", "target_id"], "left")
    rows = rows.withColumn("maybe_outside", F.col("unbounded") | (F.col("bounded") & (F.col("bound_relation") != "covered")))
    rows = rows.fillna(False, ["inside", "outside", "relevant", "maybe_outside"])
    ok, some = F.col("failed").isNull(), F.col("inside") | F.col("outside")
    relation = (
        F.when(F.col("inside") & F.col("outside"), "partial")
        .when(F.col("inside") & ~F.col("maybe_outside"), "inside")
        .when(F.col("outside") & ~F.col("relevant"), "outside")
        .otherwise("unknown")
    )
    return rows.select(
        "track_id",
        "target_id",
        F.coalesce("failed.status", F.lit("OK")).alias("status"),
        F.when(ok, some).alias("assessable"),
        F.when(ok & some, relation).alias("relation"),
        F.when(ok & some, F.when(F.col("relevant"), "incomplete").otherwise("complete")).alias("completeness"),
        F.when(ok & ~some, "NO_POSITIVE_LENGTH_USABLE_GEOMETRY").alias("reason"),
    )


def refused(tracks: DataFrame, issues: DataFrame) -> DataFrame:
    """The pairs of each track with the targets that aren't valid: their code (target_id, code) is the outcome, nothing is told."""
    pairs = tracks.select("track_id").distinct().crossJoin(shared_ids(issues))
    nothing = [F.lit(None).cast(kind).alias(n) for n, kind in (("assessable", "boolean"), ("relation", "string"), ("completeness", "string"), ("reason", "string"))]
    return pairs.select("track_id", "target_id", F.col("code").alias("status"), *nothing)


def uncertainties(relevance: DataFrame) -> DataFrame:
    """The unresolved gaps of each pair, with open ends as nulls."""
    return relevance.filter("unresolved").select("track_id", "target_id", "gap_index", "start", "end", "kind", "causes", "classification", F.col("reason").alias("relevance"))


def assessment_rules(assessments: DataFrame, uncertain: DataFrame, segments: DataFrame) -> DataFrame:
    """(track_id, target_id, code) where an assessment contradicts its own lists."""
    u = uncertain.groupBy("track_id", "target_id").agg(F.count("*").alias("uncertain"))
    s = segments.groupBy("track_id", "target_id").agg(F.count("*").alias("segments"))
    rows = assessments.join(u, ["track_id", "target_id"], "left").join(s, ["track_id", "target_id"], "left").fillna(0, ["uncertain", "segments"])
    relation, completeness = F.col("relation"), F.col("completeness")
    rules = {
        "INCOMPLETE_WITHOUT_UNCERTAINTY": (completeness == "incomplete") & (F.col("uncertain") == 0),
        "COMPLETE_WITH_UNCERTAINTY": (completeness == "complete") & (F.col("uncertain") > 0),
        "UNKNOWN_BUT_COMPLETE": (relation == "unknown") & (completeness != "incomplete"),
        "OUTSIDE_BUT_INCOMPLETE_OR_SEGMENTED": (relation == "outside") & ((completeness != "complete") | (F.col("segments") > 0)),
        "COVERED_WITHOUT_SEGMENT": relation.isin("inside", "partial") & (F.col("segments") == 0),
    }
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda c: c.isNotNull())
    return rows.select("track_id", "target_id", F.explode_outer(codes).alias("code")).filter("code IS NOT NULL")
