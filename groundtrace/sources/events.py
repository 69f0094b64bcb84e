"""Tracks from the ``events`` table.

The table has no coordinates, so these are derived from its columns by a fixed rule, on a grid of
eighths of a degree where differences and cross products are exact in binary floating point:

* one track for each user_id, records in the order of event_id;
* ``error`` events are records without a position; ``signup`` events have no time; every 41st event_id
  is stamped two days early; other times are ``ts``;
* lon = ((k mod 16) - 8) / 8 with k from ``props``, lat = ((37 * event_id) mod 16 - 8) / 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.functions.scalars import utc_text

EARLY_EVERY, EARLY_MICROS = 41, 2 * 86_400 * 1_000_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def samples(events: DataFrame) -> DataFrame:
    """Parsed samples of the tracks, in the form that ``operators.normalize`` reads."""
    k = F.get_json_object("props", "$.k").cast("long")
    micros = _micros(F.col("ts")) - F.when(F.col("event_id") % EARLY_EVERY == 0, F.lit(EARLY_MICROS)).otherwise(F.lit(0))
    placed = F.col("event_type") != "error"
    order = W.partitionBy("user_id").orderBy("event_id")
    return events.select(
        F.col("user_id").alias("track_id"),
        F.lit(0).alias("part_ord"),
        F.col("event_id").alias("sample_ord"),
        (F.row_number().over(order) - 1).cast("long").alias("record_index"),
        F.when(placed, (k % 16 - 8) / 8.0).alias("lon"),
        F.when(placed, ((37 * F.col("event_id")) % 16 - 8) / 8.0).alias("lat"),
        F.when(~placed, "POSITION_MISSING").alias("position_code"),
        F.when(placed & (F.col("event_type") != "signup"), utc_text(micros)).alias("ts_text"),
        F.lit(None).cast("string").alias("ts_code"),
        F.lit(None).cast("double").alias("altitude_m"),
        F.lit(None).cast("double").alias("distance_m"),
        F.lit(None).cast("double").alias("observed_speed_mps"),
    )


def part_samples(events: DataFrame) -> DataFrame:
    """The same records with every run of positioned ones as a track of its own: tracks without gaps."""
    own = samples(events)
    order = W.partitionBy("track_id").orderBy("sample_ord")
    run = F.sum(F.when(F.col("lon").isNull(), 1).otherwise(0)).over(order)
    own = own.withColumn("run", run).filter("lon IS NOT NULL")
    number = W.partitionBy("track_id", "run").orderBy("sample_ord")
    named = F.concat(F.col("track_id").cast("string"), F.lit("/"), F.col("run").cast("string"))
    return own.withColumn("record_index", (F.row_number().over(number) - 1).cast("long")).withColumn("track_id", named).drop("run")
