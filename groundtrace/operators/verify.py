"""Verifiers: claimed tables against what the evidence gives, as rows (track_id[, target_id], code).

Each check is its own computation on the claim; equality with a recomputed table comes last. No rows, no issue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.functions.scalars import in_domain
from groundtrace.operators.normalize import GAP_CODES
from groundtrace.operators.quality import REJECTED
from groundtrace.plans.assessment import Assessment


def _issue(rows: DataFrame, code: str, *keys: str) -> DataFrame:
    return rows.select(*(keys or ("track_id",)), F.lit(code).alias("code")).distinct()


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)


def surplus(claimed: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that two tables hold a different number of times, with ``surplus``: how many more the claimed one has. Each table is read once."""
    names = claimed.columns
    both = claimed.select(*names, F.lit(1).alias("surplus")).unionByName(expected.select(*names, F.lit(-1).alias("surplus")))
    return both.groupBy(*names).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def differences(claimed: DataFrame, expected: DataFrame, code: str, *keys: str) -> DataFrame:
    """Rows that only one of two tables holds, repeats counted."""
    return _issue(surplus(claimed, expected), code, *(keys or ("track_id",)))


def schema_issues(rows: DataFrame, rules: dict[tuple[str, str], Column], *keys: str) -> DataFrame:
    """(keys, path, rule) of each row that breaks a rule; ``rules``: (path, rule) -> condition that has to hold. Null breaks it."""
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))) for (path, rule), holds in sorted(rules.items())])
    found = rows.select(*keys, F.explode_outer(F.filter(broken, lambda b: b.isNotNull())).alias("b"))
    return found.filter("b IS NOT NULL").select(*keys, "b.path", "b.rule")


def evidence_issues(observations: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The canonical track itself: coordinates, indices without holes, records in order and accounted for, gaps at every part boundary."""
    part = W.partitionBy("track_id", "part_index").orderBy("observation_index")
    track = W.partitionBy("track_id").orderBy("part_index", "observation_index")
    numbered = observations.withColumns({"expected": F.row_number().over(part) - 1, "before": F.lag("record_index").over(track)})
    parts = observations.groupBy("track_id").agg(F.max("part_index").alias("last"), F.count_distinct("part_index").alias("n"))
    lost = diagnostics.filter(F.col("code").isin("POSITION_MISSING", "POSITION_INVALID_SENTINEL")).select("track_id", "record_index")
    accounted = observations.select("track_id", "record_index").unionByName(lost).groupBy("track_id")
    accounted = accounted.agg(F.count("*").alias("n"), F.count_distinct("record_index").alias("distinct"), F.max("record_index").alias("last"))
    bounds = diagnostics.filter(F.col("code").isin(*GAP_CODES) & F.col("previous").isNotNull() & F.col("next").isNotNull())
    skips = bounds.filter(F.col("next.part_index") != F.col("previous.part_index") + 1)
    needed = parts.filter("last > 0").select("track_id", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("part"))
    marked = bounds.select("track_id", F.col("previous.part_index").alias("part")).distinct()
    return _all([
        _issue(observations.filter(~in_domain(F.col("lon"), F.col("lat"))), "QUALITY_EVIDENCE_INVALID"),
        _issue(numbered.filter("expected <> observation_index OR before >= record_index OR record_index < 0"), "SOURCE_MAPPING_INVALID"),
        _issue(parts.filter("n <> last + 1"), "SOURCE_MAPPING_INVALID"),
        _issue(accounted.filter("n <> distinct OR n <> last + 1"), "SOURCE_MAPPING_INVALID"),
        _issue(skips, "SOURCE_GAP_EVIDENCE_INVALID"),
        _issue(needed.join(marked, ["track_id", "part"], "left_anti"), "SOURCE_GAP_EVIDENCE_MISSING"),
    ]).distinct()


def edge_claims(usable: DataFrame, excluded: DataFrame) -> DataFrame:
    """(track_id, part_index, edge_index, claim): the edges of usable intervals and of exclusions."""
    one = usable.select("track_id", "part_index", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("edge_index"), F.lit("usable").alias("claim"))
    return one.unionByName(excluded.select("track_id", "part_index", "edge_index", F.lit("excluded").alias("claim")))


def unclaimed_edges(edges: DataFrame, usable: DataFrame, excluded: DataFrame) -> DataFrame:
    return edges.select("track_id", "part_index", "edge_index").join(edge_claims(usable, excluded), ["track_id", "part_index", "edge_index"], "left_anti")


def repeated_claims(usable: DataFrame, excluded: DataFrame) -> DataFrame:
    return edge_claims(usable, excluded).groupBy("track_id", "part_index", "edge_index").count().filter("count > 1")


def quality_issues(a: Assessment, usable: DataFrame, excluded: DataFrame, gaps: DataFrame) -> DataFrame:
    """Claimed usable intervals, exclusions and gaps of tracks against their evidence."""
    edges = a.decided.select("track_id", "part_index", "edge_index", "decision")
    order = W.partitionBy("track_id", "part_index").orderBy("low")
    touching = usable.withColumn("before", F.lag("high").over(order)).filter("before = low")
    bridged = touching.join(edges.filter(F.col("decision") == REJECTED), ["track_id", "part_index"], "left_anti")
    reasons = excluded.join(edges, ["track_id", "part_index", "edge_index"], "left").filter(~F.col("reason").eqNullSafe(F.col("decision")) | (F.col("reason") != REJECTED))
    names = ["track_id", "start", "end", "kind", "causes", "diagnostic_indices", "excluded_index", "gap_index"]
    text = lambda d: d.select("track_id", F.to_json(F.struct(*names)).alias("gap"))
    return _all([
        _issue(usable.filter("low >= high"), "USABLE_INTERVAL_INVALID"),
        _issue(edge_claims(usable, excluded).join(edges, ["track_id", "part_index", "edge_index"], "left_anti"), "INTERVAL_OUT_OF_BOUNDS"),
        _issue(unclaimed_edges(edges, usable, excluded), "EDGE_UNACCOUNTED"),
        _issue(repeated_claims(usable, excluded), "EDGE_CLAIMED_TWICE"),
        _issue(bridged, "USABLE_INTERVAL_NOT_MAXIMAL"),
        _issue(reasons, "EXCLUSION_DECISION_MISMATCH"),
        differences(usable, a_usable_intervals(a), "USABLE_INTERVALS_MISMATCH"),
        differences(text(gaps), text(a.gaps), "GAPS_MISMATCH"),
    ])


def a_usable_intervals(a: Assessment) -> DataFrame:
    from groundtrace.operators.quality import usable_intervals

    return usable_intervals(a.decided.drop("run"))


def tiling(fragments: DataFrame) -> DataFrame:
    """(track_id, target_id, part_index, edge_index, broken): whether an edge's fragments don't cover 0 to 1 one after another in turns."""
    keys = ["track_id", "target_id", "part_index", "edge_index"]
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    rows = fragments.withColumns({"before": F.lag("hi").over(order), "last_class": F.lag("covered").over(order)})
    rows = rows.withColumn("gap", (F.coalesce("before", F.lit(0.0)) != F.col("lo")) | (F.col("lo") >= F.col("hi")) | F.coalesce(F.col("last_class") == F.col("covered"), F.lit(False)))
    return rows.groupBy(*keys).agg((F.max("gap") | (F.max("hi") != 1)).alias("broken"))


def tiling_issues(fragments: DataFrame) -> DataFrame:
    """(track_id, target_id, part_index, edge_index) whose fragments don't tile their edge."""
    return tiling(fragments).filter("broken").drop("broken")


def spatial_issues(a: Assessment, fragments: DataFrame, relations: DataFrame) -> DataFrame:
    """Claimed fragments and relations of pairs against the evidence."""
    keys = ("track_id", "target_id")
    names = ["track_id", "target_id", "part_index", "edge_index", "lo", "hi", "covered"]
    edges = a.usable.filter("x0 <> x1 OR y0 <> y1").select("track_id", "part_index", "edge_index")
    return _all([
        _issue(tiling_issues(fragments), "FRAGMENTS_DO_NOT_TILE", *keys),
        _issue(fragments.join(edges, ["track_id", "part_index", "edge_index"], "left_anti"), "FRAGMENT_OUTSIDE_USABLE_EDGES", *keys),
        differences(fragments.select(names), a.fragments.select(names), "SPATIAL_COVERAGE_MISMATCH", *keys),
        differences(relations.select("track_id", "target_id", "relation"), a.relations.select("track_id", "target_id", "relation"), "ASSESSMENT_RELATION_CONTRADICTS_EVIDENCE", *keys),
        differences(relations.select("track_id", "target_id", "completeness"), a.relations.select("track_id", "target_id", "completeness"), "COVERAGE_COMPLETENESS_UNPROVEN", *keys),
        _issue(relations.join(a.relations.filter("NOT assessable").select(*keys), list(keys)).filter("relation IS NOT NULL"), "TRACK_NOT_ASSESSABLE", *keys),
    ])


def _in_track(end: str, sizes: Column) -> Column:
    at = F.col(end)
    fraction = at["fraction_to_next"]
    return (at["part_index"] == F.col("part_index")) & at["observation_index"].between(0, sizes - 1) & (fraction >= 0) & (fraction < 1) & ((fraction == 0) | (at["observation_index"] < sizes - 1))


def entity_issues(a: Assessment, segments: DataFrame) -> DataFrame:
    """Claimed segments (track_id, target_id, ordinal, part_index, start, end) against the evidence."""
    keys = ("track_id", "target_id")
    sizes = a.observations.groupBy("track_id", "part_index").agg(F.count("*").alias("size"))
    placed = segments.join(sizes, ["track_id", "part_index"], "left")
    order = W.partitionBy(*keys).orderBy("ordinal")
    ordered = segments.withColumns({"expected": F.row_number().over(order) - 1, "before": F.lag("end").over(order)})
    crossing = segments.filter("start.part_index <> end.part_index")
    spans = lambda d: d.select(*keys, "part_index", "start", "end")
    differ = surplus(spans(segments), spans(a.segments))
    return _all([
        _issue(crossing, "TARGET_SEGMENT_CROSSES_PART", *keys),
        _issue(placed.filter("start.part_index = end.part_index").filter(F.col("size").isNull() | ~_in_track("start", F.col("size")) | ~_in_track("end", F.col("size"))), "TRACK_POSITION_OUT_OF_BOUNDS", *keys),
        _issue(segments.filter("NOT start < end"), "TARGET_SEGMENT_ORDER_INVALID", *keys),
        _issue(ordered.filter("expected <> ordinal OR before >= start"), "TARGET_SEGMENT_ORDER_INVALID", *keys),
        differ.select(*keys, F.when(F.col("surplus") < 0, "TARGET_COVERAGE_NOT_EXHAUSTIVE").otherwise("TARGET_SEGMENT_LINEAGE_MISMATCH").alias("code")),
    ]).distinct()
