"""Canonical tracks: continuity parts, indices, and diagnostics with their positioned neighbours.

A part is a maximal run of positioned samples of one source part: a sample without a position and a
source boundary both end it. Nothing is sorted by time, dropped, merged or made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.functions.scalars import utc_seconds

GAP_CODES = ("SOURCE_CONTINUITY_BREAK", "EMPTY_SOURCE_PART", "POSITION_MISSING", "POSITION_INVALID_SENTINEL")
OBSERVATION = ("track_id", "part_index", "observation_index", "lineage_index", "record_index", "lon", "lat", "ts_text", "seconds", "altitude_m", "distance_m", "observed_speed_mps")


def _placed(samples: DataFrame) -> DataFrame:
    """Samples with ``part_index`` (of positioned ones)."""
    order = W.partitionBy("track_id").orderBy("part_ord", "sample_ord")
    positioned = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    rows = samples.withColumn("positioned", positioned)
    follows = F.coalesce(F.lag("positioned").over(order), F.lit(False)) & (F.lag("part_ord").over(order) == F.col("part_ord"))
    starts = F.when(F.col("positioned") & ~follows, 1).otherwise(0)
    return rows.withColumn("starts", starts).withColumn("part_index", (F.sum("starts").over(order) - 1).cast("int")).drop("starts")


def observations(samples: DataFrame) -> DataFrame:
    """One row for each positioned sample, with its place in the track. All windows share one partitioning by track."""
    rows = _placed(samples).filter("positioned")
    part = W.partitionBy("track_id", "part_index").orderBy("sample_ord")
    track = W.partitionBy("track_id").orderBy("part_ord", "sample_ord")
    rows = rows.withColumn("lineage_index", (F.row_number().over(track) - 1).cast("int"))
    rows = rows.withColumn("observation_index", (F.row_number().over(part) - 1).cast("int")).withColumn("seconds", utc_seconds(F.col("ts_text")))
    return rows.select(*OBSERVATION)


def diagnostics(samples: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(track_id, diagnostic_index, code, field, record_index, previous, next).

    ``parts`` (track_id, part_ord) lists the source parts, empty ones too; by default those of the samples.
    ``previous`` and ``next`` are the nearest positioned places, null at the ends. Two running windows, one in
    each direction, find them: an as-of join in both directions without a join.
    """
    rows = _placed(samples)
    part = W.partitionBy("track_id", "part_index").orderBy("sample_ord")
    at = F.when(F.col("positioned"), F.struct("part_index", (F.sum(F.col("positioned").cast("int")).over(part) - 1).cast("int").alias("observation_index")))
    none = F.lit(None).cast("string")
    place = rows.select("track_id", "part_ord", "sample_ord", F.lit(2).alias("kind"), none.alias("code"), none.alias("field"), "record_index", at.alias("at")).filter("at IS NOT NULL")
    own = F.explode(F.filter(F.array(F.struct(F.col("position_code").alias("code"), F.lit("position").alias("field")), F.struct(F.col("ts_code").alias("code"), F.lit("timestamp").alias("field"))), lambda d: d["code"].isNotNull()))
    empty = F.lit(None).cast("struct<part_index: int, observation_index: int>")
    said = rows.select("track_id", "part_ord", "sample_ord", F.lit(1).alias("kind"), own.alias("d"), "record_index").select("track_id", "part_ord", "sample_ord", "kind", "d.code", "d.field", "record_index", empty.alias("at"))
    bounds = samples.groupBy("track_id", "part_ord").agg(F.count("*").alias("n"))
    if parts is not None:
        bounds = parts.select("track_id", "part_ord").distinct().join(bounds, ["track_id", "part_ord"], "left")
    codes = F.filter(F.array(F.when(F.col("part_ord") > 0, F.lit(GAP_CODES[0])), F.when(F.col("n").isNull(), F.lit(GAP_CODES[1]))), lambda c: c.isNotNull())
    bounds = bounds.select("track_id", "part_ord", F.posexplode(codes).alias("k", "code"))
    bounds = bounds.select("track_id", "part_ord", F.lit(-1).cast("long").alias("sample_ord"), F.col("k").alias("kind"), "code", none.alias("field"), F.lit(None).cast("long").alias("record_index"), empty.alias("at"))
    every = place.unionByName(said).unionByName(bounds)
    key = ("part_ord", "sample_ord", "kind", "code")
    forward = W.partitionBy("track_id").orderBy(*key).rowsBetween(W.unboundedPreceding, W.currentRow)
    backward = W.partitionBy("track_id").orderBy(*[F.desc(k) for k in key]).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = every.withColumn("next", F.last("at", ignorenulls=True).over(backward)).withColumn("previous", F.last("at", ignorenulls=True).over(forward))
    number = F.row_number().over(W.partitionBy("track_id").orderBy(*key)) - 1
    return every.filter("at IS NULL").withColumn("diagnostic_index", number.cast("int")).select("track_id", "diagnostic_index", "code", "field", "record_index", "previous", "next")


def outcomes(samples: DataFrame) -> DataFrame:
    """(track_id, outcome): whether a track has any position."""
    placed = F.max(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return samples.groupBy("track_id").agg(F.when(placed, "success").otherwise("no_positioned_observations").alias("outcome"))
