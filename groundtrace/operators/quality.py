"""Quality: whole-edge speed screening, usable runs, exclusions, gaps and their constraints.

Evidence is never edited: a rejected edge only leaves the usable runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.functions.canonical import exact_seconds
from groundtrace.functions.geodesy import inverse_metres
from groundtrace.functions.scalars import utc_is_exact
from groundtrace.operators.normalize import GAP_CODES

#: Metres by which a distance may be off before a comparison with the speed cap counts as undecided.
GUARD_M = 1e-6
REJECTED = "IMPLIED_SPEED_EXCEEDS_POLICY"
WORLD = (-180.0, -90.0, 180.0, 90.0)


@dataclass(frozen=True)
class Policy:
    """Both choices are explicit: a speed cap in m/s or None, and whether gaps are bounded by the whole domain."""

    max_implied_speed_mps: float | None
    include_domain_bounds: bool = True

    def __post_init__(self) -> None:
        cap = self.max_implied_speed_mps
        if cap is not None and (type(cap) not in (int, float) or not math.isfinite(cap) or cap <= 0):
            raise ValueError("the speed cap is a finite positive number or None")
        if type(self.include_domain_bounds) is not bool:
            raise ValueError("include_domain_bounds is a bool")


def edges(observations: DataFrame) -> DataFrame:
    """Neighbouring observations of one part; never an edge between parts."""
    order = W.partitionBy("track_id", "part_index").orderBy("observation_index")
    following = {n: F.lead(c).over(order) for n, c in (("x1", "lon"), ("y1", "lat"), ("ts1", "ts_text"), ("seconds1", "seconds"), ("lineage1", "lineage_index"))}
    return (
        observations.withColumns(following)
        .filter("x1 IS NOT NULL")
        .select(
            "track_id", "part_index", F.col("observation_index").alias("edge_index"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), "x1", "y1",
            F.col("ts_text").alias("ts0"), "ts1", F.col("seconds").alias("seconds0"), "seconds1", F.col("lineage_index").alias("lineage0"), "lineage1",
        )
    )


def stationary() -> Column:
    """Equal coordinates, without tolerance."""
    return (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))


def _exact_decision(start: str, end: str, metres: float | None, cap: float) -> str:
    """The decision with rational numbers."""
    dt = exact_seconds(end) - exact_seconds(start)
    if dt <= 0:
        return "SPEED_TIME_NONINCREASING"
    if metres is None:
        return "SPEED_DISTANCE_UNAVAILABLE"
    over = Fraction(metres) - Fraction(cap) * dt
    return REJECTED if over > Fraction(GUARD_M) else "SPEED_NUMERICALLY_INDETERMINATE" if over > -Fraction(GUARD_M) else "ADMITTED"


def _screened(cap: float) -> Column:
    """struct(metres, exactly): the distance, and the decision with rational numbers for times with more digits than the decimals hold and for near ties.

    One call, so that a task needs one Python worker for it; a filter on the decision doesn't compute it again.
    """
    kind = pa.struct([("metres", pa.float64()), ("exactly", pa.string())])

    def screen(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, start: pa.Array, end: pa.Array, dt: pa.Array, inexact: pa.Array) -> pa.Array:
        metres = inverse_metres(*(side.to_numpy(zero_copy_only=False) for side in (x0, y0, x1, y1)))
        known, span = np.isfinite(metres), dt.to_numpy(zero_copy_only=False).astype(float)
        with np.errstate(invalid="ignore"):
            near = np.abs(metres - cap * span) <= 2 * GUARD_M + 1e-12 * (np.abs(metres) + cap * np.abs(span))
        told = np.full(len(metres), None, object)
        for row in np.flatnonzero(((known & near) | inexact.to_numpy(zero_copy_only=False).astype(bool)) & ~np.isnan(span)).tolist():
            told[row] = _exact_decision(start[row].as_py(), end[row].as_py(), float(metres[row]) if known[row] else None, cap)
        return pa.StructArray.from_arrays([pa.array(metres, mask=~known), pa.array(told, pa.string())], fields=list(kind))

    inexact = F.coalesce(~utc_is_exact(F.col("ts0")) | ~utc_is_exact(F.col("ts1")), F.lit(False))
    call = F.arrow_udf(screen, "struct<metres: double, exactly: string>").asNondeterministic()
    return call("x0", "y0", "x1", "y1", "ts0", "ts1", "dt", inexact)


def decisions(edges: DataFrame, policy: Policy) -> DataFrame:
    """``edges`` with ``dt`` in seconds, ``distance_m`` and ``decision``. Without a cap no distance is computed."""
    cap = policy.max_implied_speed_mps
    rows = edges.withColumn("dt", (F.col("seconds1") - F.col("seconds0")).cast("double"))
    if cap is None:
        return rows.withColumn("distance_m", F.lit(None).cast("double")).withColumn("decision", F.lit("SPEED_RULE_DISABLED"))
    rows = rows.withColumn("screened", _screened(float(cap))).withColumns({"distance_m": F.col("screened.metres"), "exactly": F.col("screened.exactly")}).drop("screened")
    decision = (
        F.when(F.col("ts0").isNull() | F.col("ts1").isNull(), "SPEED_TIME_MISSING")
        .when(F.col("seconds0").isNull() | F.col("seconds1").isNull(), "SPEED_TIME_UNSUPPORTED")
        .when(F.col("exactly").isNotNull(), F.col("exactly"))
        .when(F.col("seconds1") <= F.col("seconds0"), "SPEED_TIME_NONINCREASING")
        .when(F.col("distance_m").isNull(), "SPEED_DISTANCE_UNAVAILABLE")
        .when(F.col("distance_m") - GUARD_M > cap * F.col("dt"), REJECTED)
        .when(F.col("distance_m") + GUARD_M > cap * F.col("dt"), "SPEED_NUMERICALLY_INDETERMINATE")
        .otherwise("ADMITTED")
    )
    return rows.withColumn("decision", decision).drop("exactly")


def with_runs(decided: DataFrame) -> DataFrame:
    """Adds ``run``: the number of rejected edges before in the part. Usable edges of one run follow each other."""
    order = W.partitionBy("track_id", "part_index").orderBy("edge_index")
    return decided.withColumn("run", F.sum(F.when(F.col("decision") == REJECTED, 1).otherwise(0)).over(order).cast("int"))


def usable_intervals(decided: DataFrame) -> DataFrame:
    """Maximal runs of edges that aren't rejected, from observation ``low`` to ``high``."""
    runs = with_runs(decided).filter(F.col("decision") != REJECTED).groupBy("track_id", "part_index", "run")
    return runs.agg(F.min("edge_index").alias("low"), (F.max("edge_index") + 1).alias("high")).drop("run")


def excluded_intervals(decided: DataFrame) -> DataFrame:
    """Rejected edges in order, with the lineage of their two observations."""
    order = W.partitionBy("track_id").orderBy("part_index", "edge_index")
    rows = decided.filter(F.col("decision") == REJECTED)
    return rows.select("track_id", (F.row_number().over(order) - 1).cast("int").alias("excluded_index"), "part_index", "edge_index", F.col("decision").alias("reason"), "lineage0", "lineage1")


def edge_diagnostics(decided: DataFrame) -> DataFrame:
    """Edges that are usable without having passed the screening."""
    return decided.filter(~F.col("decision").isin("ADMITTED", REJECTED)).select("track_id", "part_index", "edge_index", F.col("decision").alias("code"))


def source_gaps(diagnostics: DataFrame) -> DataFrame:
    """One gap for each pair of neighbours of gap diagnostics, with all of these in order."""
    said = diagnostics.filter(F.col("code").isin(*GAP_CODES)).groupBy("track_id", "previous", "next")
    rows = said.agg(F.array_sort(F.collect_list(F.struct("diagnostic_index", "code"))).alias("said"))
    return rows.select(
        "track_id", F.col("previous").alias("start"), F.col("next").alias("end"), F.lit("source_gap").alias("kind"), F.array_distinct("said.code").alias("causes"),
        F.col("said.diagnostic_index").alias("diagnostic_indices"), F.lit(None).cast("int").alias("excluded_index"),
    )


def quality_gaps(excluded: DataFrame) -> DataFrame:
    """One gap for each rejected edge."""
    at = lambda shift: F.struct("part_index", (F.col("edge_index") + shift).alias("observation_index"))
    return excluded.select(
        "track_id", at(0).alias("start"), at(1).alias("end"), F.lit("quality_exclusion").alias("kind"), F.array("reason").alias("causes"),
        F.array().cast("array<int>").alias("diagnostic_indices"), "excluded_index",
    )


def gaps(diagnostics: DataFrame, excluded: DataFrame) -> DataFrame:
    """All gaps of a track, numbered from start to end; open starts first, open ends last."""
    every = source_gaps(diagnostics).unionByName(quality_gaps(excluded))
    first = F.least(F.coalesce(F.element_at("diagnostic_indices", F.when(F.size("diagnostic_indices") > 0, 1)), F.lit(0)), F.lit(2**31 - 1))
    order = W.partitionBy("track_id").orderBy(F.col("start").asc_nulls_first(), F.col("end").asc_nulls_last(), F.col("kind"), first, F.col("excluded_index"))
    return every.withColumn("gap_index", (F.row_number().over(order) - 1).cast("int"))


def gap_constraints(gaps: DataFrame, policy: Policy) -> DataFrame:
    """A bound for each gap, the whole domain, if the policy includes them."""
    bound = F.struct(*[F.lit(v).alias(n) for n, v in zip(("min_lon", "min_lat", "max_lon", "max_lat"), WORLD, strict=True)])
    rows = gaps.select("track_id", "gap_index", bound.alias("bound"))
    return rows if policy.include_domain_bounds else rows.limit(0)
