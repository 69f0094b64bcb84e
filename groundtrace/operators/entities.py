"""Target segments: maximal covered stretches of usable runs, their vertices and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundtrace.functions.scalars import interpolate, position


def segments(fragments: DataFrame, stationary: DataFrame, runs: DataFrame) -> DataFrame:
    """(track_id, target_id, ordinal, part_index, run, start, end, pieces).

    Covered fragments and covered stationary edges of one usable run (``runs``: track_id, part_index, edge_index, run)
    are joined where one ends at the place where the next starts; what has no positive length in it is left out.
    """
    positive = fragments.filter("covered").select("track_id", "target_id", "part_index", "edge_index", "lo", "hi", F.lit(True).alias("positive"))
    still = stationary.filter("covered").select("track_id", "target_id", "part_index", "edge_index", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(False).alias("positive"))
    rows = positive.unionByName(still).join(runs.select("track_id", "part_index", "edge_index", "run"), ["track_id", "part_index", "edge_index"])
    rows = rows.withColumns({"start": position("part_index", "edge_index", "lo"), "end": position("part_index", "edge_index", "hi")})
    order = W.partitionBy("track_id", "target_id", "part_index", "run").orderBy("start", "end")
    rows = rows.withColumn("begins", F.when(F.lag("end").over(order) == F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = rows.groupBy("track_id", "target_id", "part_index", "run", "island")
    found = found.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("positive").alias("positive"), F.count("*").alias("pieces")).filter("positive")
    ordinal = F.row_number().over(W.partitionBy("track_id", "target_id").orderBy("start")) - 1
    return found.select("track_id", "target_id", ordinal.cast("int").alias("ordinal"), "part_index", "run", "start", "end", "pieces")


def segment_edges(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """The pieces of parent edges that a segment consists of, in order, with the columns of ``edges``: f0 to f1 of ``edge_index``."""
    last = F.when(F.col("end.fraction_to_next") > 0, F.col("end.observation_index")).otherwise(F.col("end.observation_index") - 1)
    at = F.posexplode_outer(F.sequence(F.col("start.observation_index"), last)).alias("fragment_ordinal", "edge_index")
    rows = segments.select("track_id", "target_id", "ordinal", "part_index", "start", "end", at)
    first = F.col("edge_index") == F.col("start.observation_index")
    rows = rows.withColumns({
        "f0": F.when(first, F.col("start.fraction_to_next")).otherwise(0.0),
        "f1": F.when((F.col("edge_index") == F.col("end.observation_index")) & (F.col("end.fraction_to_next") > 0), F.col("end.fraction_to_next")).otherwise(1.0),
    })
    return rows.drop("start", "end").join(edges, ["track_id", "part_index", "edge_index"])


def _at(fraction: str) -> list:
    f = F.col(fraction)
    whole = lambda a, b: F.when(f == 1, F.col(b)).otherwise(interpolate(F.col(a), F.col(b), f))
    return [whole("x0", "x1"), whole("y0", "y1")]


def placed_edges(segment_edges: DataFrame) -> DataFrame:
    """Adds the coordinates (ax, ay) and (bx, by) of the ends of each piece."""
    (ax, ay), (bx, by) = _at("f0"), _at("f1")
    return segment_edges.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})


def vertices(placed: DataFrame) -> DataFrame:
    """(track_id, target_id, ordinal, vertex, x, y): start, every observation on the way, repeated ones too, and end."""
    begin = placed.select("track_id", "target_id", "ordinal", F.col("fragment_ordinal").alias("vertex"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    last = placed.groupBy("track_id", "target_id", "ordinal").agg(F.max(F.struct("fragment_ordinal", "bx", "by")).alias("m"))
    end = last.select("track_id", "target_id", "ordinal", (F.col("m.fragment_ordinal") + 1).alias("vertex"), F.col("m.bx").alias("x"), F.col("m.by").alias("y"))
    return begin.unionByName(end)


def geometries(placed: DataFrame) -> DataFrame:
    """(track_id, target_id, ordinal, coordinates): each segment's line, array of [x, y]."""
    rows = vertices(placed).groupBy("track_id", "target_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y"))).alias("v"))
    return rows.select("track_id", "target_id", "ordinal", F.transform("v", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))


def identified(segments: DataFrame) -> DataFrame:
    """Adds ``segment_id``, a digest of what a segment is: its track, target and bounds."""
    ends = [F.hex(F.col(f"{e}.fraction_to_next").cast("string").cast("binary")) for e in ("start", "end")]
    parts = [F.col("track_id").cast("string"), F.col("target_id"), F.col("part_index").cast("string"), F.col("start.observation_index").cast("string"), ends[0], F.col("end.observation_index").cast("string"), ends[1]]
    return segments.withColumn("segment_id", F.concat(F.lit("segment-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 40)))
