"""GPX 1.1 tracks, parsed by ``from_xml`` and checked by predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.functions.scalars import number_code

NAMESPACE = "http://www.topografix.com/GPX/1/1"
POINT = "struct<_lat: string, _lon: string, ele: string, time: string>"
SCHEMA = f"_version string, _creator string, trk array<struct<trkseg: array<struct<trkpt: array<{POINT}>>>>>, rte array<struct<name: string>>, wpt array<struct<_lat: string>>, _corrupt_record string"
DATE_TIME = r"^-?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def _bare(text: Column) -> Column:
    """The document without comments and with a prefix of its namespace taken off the tags."""
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    prefix = F.regexp_extract(plain, r'(?s)<(\w+):gpx\s[^>]*xmlns:\1\s*=\s*["\']' + NAMESPACE, 1)
    return F.when(prefix == "", plain).otherwise(F.regexp_replace(plain, F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1")))


def _utc(text: Column) -> tuple[Column, Column]:
    """(UTC text, code): a time of any zone in UTC with all digits of its second."""
    trimmed = F.trim(text)
    whole, part, zone = (F.regexp_extract(trimmed, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})?$", k) for k in (1, 2, 3))
    at = F.try_to_timestamp(F.concat(F.replace(whole, F.lit("T"), F.lit(" ")), F.when(zone == "Z", "+00:00").otherwise(zone)), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    code = F.when(whole == "", "TIMESTAMP_UNREPRESENTABLE").when(zone == "", "TIMESTAMP_TIMEZONE_MISSING").when(at.isNull(), "TIMESTAMP_UNREPRESENTABLE")
    shown = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("Z"))
    return F.when(text.isNotNull() & code.isNull(), shown), F.when(text.isNotNull(), code)


def parse_gpx(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failures: source_id, code; samples; parts: track_id, part_ord) of (source_id, content)."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.select("source_id", _bare(text).alias("text"))
    rows = rows.withColumn("g", F.from_xml("text", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    root = F.regexp_extract("text", r"(?s)^\s*(?:<\?xml.*?\?>)?\s*<(\w+)[\s>]", 1)
    spaced = F.col("text").rlike(r'(?s)<gpx\s[^>]*xmlns(:\w+)?\s*=\s*["\']' + NAMESPACE)
    declared = F.col("text").rlike(r"(?s)<!DOCTYPE")
    points = F.flatten(F.flatten(F.transform(F.coalesce("g.trk", F.array().cast(f"array<struct<trkseg: array<struct<trkpt: array<{POINT}>>>>>")), lambda t: F.transform(F.filter(t["trkseg"], lambda s: s.isNotNull()), lambda s: F.coalesce(s["trkpt"], F.array().cast(f"array<{POINT}>"))))))

    def bad(p: Column) -> Column:
        lat, lon = p["_lat"].try_cast("double"), p["_lon"].try_cast("double")
        fits = lat.between(-90, 90) & (lon >= -180) & (lon < 180)
        plain = p["_lat"].rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$") & p["_lon"].rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$")
        high = p["ele"].isNull() | p["ele"].rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$")
        return ~F.coalesce(fits & plain, F.lit(False)) | ~high | ~(p["time"].isNull() | F.trim(p["time"]).rlike(DATE_TIME))

    broken = F.col("g").isNull() | F.col("g._corrupt_record").isNotNull() | F.col("text").isNull()
    code = (
        F.when(declared, "UNSUPPORTED_GPX_DTD")
        .when(broken, "MALFORMED_SOURCE")
        .when((root != "gpx") | ~spaced | ~F.col("g._version").eqNullSafe("1.1") | F.col("g._creator").isNull() | F.exists(points, bad), "INVALID_GPX_STRUCTURE")
        .when((F.size("g.rte") > 0) | (F.size("g.wpt") > 0), "UNSUPPORTED_GPX_ROUTE_OR_WAYPOINT")
    )
    rows = rows.withColumn("code", code)
    failures = rows.select("source_id", "code").filter("code IS NOT NULL")
    good = rows.filter("code IS NULL").select(F.col("source_id").alias("track_id"), F.posexplode_outer("g.trk").alias("track_index", "t"))
    segments = good.select("track_id", "track_index", F.posexplode_outer("t.trkseg").alias("segment_index", "s")).filter("segment_index IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("track_index", "segment_index", F.col("s.trkpt").alias("points"))))
    before = F.aggregate(F.slice("parts.points", F.lit(1), F.col("part_ord")), F.lit(0), lambda n, x: n + F.coalesce(F.size(x), F.lit(0)))
    parts = segments.groupBy("track_id").agg(listed.alias("parts")).select("track_id", "parts", F.posexplode("parts").alias("part_ord", "p")).withColumn("before", before)
    each = parts.select("track_id", "part_ord", "before", F.posexplode_outer("p.points").alias("point_index", "x")).filter("x IS NOT NULL")
    ts, ts_code = _utc(F.col("x.time"))
    samples = each.select(
        "track_id", "part_ord", F.col("point_index").cast("long").alias("sample_ord"), (F.col("before") + F.col("point_index")).cast("long").alias("record_index"),
        F.col("x._lon").cast("double").alias("lon"), F.col("x._lat").cast("double").alias("lat"), F.lit(None).cast("string").alias("position_code"),
        ts.alias("ts_text"), ts_code.alias("ts_code"), F.col("x.ele").cast("double").alias("altitude_m"),
        F.lit(None).cast("double").alias("distance_m"), F.lit(None).cast("double").alias("observed_speed_mps"),
        F.coalesce(number_code(F.trim("x._lon")), number_code(F.trim("x._lat")), number_code(F.trim("x.ele"))).alias("wrong"),
    )
    lossy = samples.groupBy(F.col("track_id").alias("source_id")).agg(F.min(F.when(F.col("wrong").isNotNull(), F.struct("record_index", "wrong"))).alias("w"))
    lossy = lossy.select("source_id", F.col("w.wrong").alias("code")).filter("code IS NOT NULL")
    gone = lossy.select(F.col("source_id").alias("track_id"))
    return failures.unionByName(lossy), samples.drop("wrong").join(gone, "track_id", "left_anti"), parts.select("track_id", "part_ord").join(gone, "track_id", "left_anti")


def gpx_counts(files: DataFrame) -> DataFrame:
    """(source_id, tracks, segments, points, times) of (source_id, content): opening tags counted in the text, without the parser."""
    text = F.regexp_replace(F.col("content").cast("string"), r"(?s)<!--.*?-->", "")
    counts = {"tracks": "trk", "segments": "trkseg", "points": "trkpt"}
    timed = F.regexp_count(text, F.lit(r"(?s)<(?:\w+:)?trkpt\b(?:(?!</(?:\w+:)?trkpt>).)*?<(?:\w+:)?time\b"))
    return files.select("source_id", *[F.regexp_count(text, F.lit(rf"<(?:\w+:)?{tag}[\s/>]")).cast("long").alias(n) for n, tag in counts.items()], timed.cast("long").alias("times"))
