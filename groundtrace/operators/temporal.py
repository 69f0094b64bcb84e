"""Time on target segments: duration, distance, speed and pace of each piece of an observed edge.

Only the times of the original edge's observations count; a clipped end has a share of their difference
and never a time of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.functions.geodesy import geodesic_metres
from groundtrace.functions.scalars import speed_bin
from groundtrace.operators.quality import Policy

MODES = ("speed_mps", "pace_s_per_km")
UNSCREENED = ("SPEED_TIME_MISSING", "SPEED_TIME_UNSUPPORTED", "SPEED_TIME_NONINCREASING", "SPEED_DISTANCE_UNAVAILABLE")


def metric_edges(placed: DataFrame, policy: Policy) -> DataFrame:
    """``placed`` pieces (with ``decision`` of their edge) with status, duration, distance, speed, pace and screening."""
    rows = placed.withColumn("length_m", geodesic_metres(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    dt = (F.col("seconds1") - F.col("seconds0")).cast("double") * (F.col("f1") - F.col("f0"))
    speed = F.col("length_m") / F.nullif(dt, F.lit(0.0))
    status = (
        F.when(F.col("ts0").isNull() | F.col("ts1").isNull(), "missing_timestamp")
        .when(F.col("seconds0").isNull() | F.col("seconds1").isNull(), "unsupported_timestamp")
        .when(F.col("seconds1") <= F.col("seconds0"), "nonincreasing_timestamp")
        .when(dt <= 0, "nonincreasing_subinterval")
        .when(F.abs(F.col("x1") - F.col("x0")) > 180, "planar_dateline_ambiguous")
        .when(F.col("length_m").isNull() | speed.isNull() | F.isnan(speed) | (speed == float("inf")), "metric_unavailable")
        .otherwise("valid")
    )
    rows = rows.withColumn("status", status)
    valid = F.col("status") == "valid"
    whole = (F.col("f0") == 0) & (F.col("f1") == 1)
    screening = (
        F.when(F.lit(policy.max_implied_speed_mps is None), "not_screened")
        .when(F.col("decision") == "ADMITTED", "passed")
        .when(F.col("decision") == "SPEED_NUMERICALLY_INDETERMINATE", "indeterminate")
        .when(F.col("decision").isin(*UNSCREENED), "unavailable")
    )
    return rows.withColumns({
        "duration_s": F.when(valid, dt),
        "distance_m": F.when(valid, F.col("length_m")),
        "speed_mps": F.when(valid, speed),
        "pace_s_per_km": F.when(valid, 1000 * dt / F.nullif(F.col("length_m"), F.lit(0.0))),
        "duration_basis": F.when(whole, "observed_parent_endpoints").otherwise("proportional_parent_edge_allocation"),
        "stationary": (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")),
        "screening": screening,
        "screening_reason": F.col("decision"),
        "bin": speed_bin(F.when(valid, speed)),
    }).drop("length_m")


def _metric_counts() -> dict[str, Column]:
    moving = ~F.col("stationary")
    return {
        "valid": F.count_if(moving & (F.col("status") == "valid")),
        "unavailable": F.count_if(moving & (F.col("status") != "valid")),
        "stationary": F.count_if(F.col("stationary")),
    }


def _screening_counts() -> dict[str, Column]:
    return {n: F.count_if(~F.col("stationary") & (F.col("screening") == n)) for n in ("passed", "indeterminate", "unavailable", "not_screened")}


def metric_counts(metrics: DataFrame) -> DataFrame:
    """valid, unavailable and stationary pieces of each pair."""
    return metrics.groupBy("track_id", "target_id").agg(*[c.alias(n) for n, c in _metric_counts().items()])


def screening_counts(metrics: DataFrame) -> DataFrame:
    """Screening results of the moving pieces of each pair."""
    return metrics.filter(~F.col("stationary")).groupBy("track_id", "target_id").agg(*[c.alias(n) for n, c in _screening_counts().items()])


def both_counts() -> tuple[Column, Column]:
    """The two as structs, for one pass over a pair's pieces; the second is null without a moving one."""
    one, two = (F.struct(*[c.alias(n) for n, c in counts.items()]) for counts in (_metric_counts(), _screening_counts()))
    return one.alias("metric_counts"), F.when(F.count_if(~F.col("stationary")) > 0, two).alias("screening_counts")
