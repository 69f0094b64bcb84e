"""Bounded ingestion of source files: bytes, digest, parser, samples, outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.functions.scalars import is_sha256
from groundtrace.operators import normalize
from groundtrace.sources.fit import parse_fit
from groundtrace.sources.gpx import parse_gpx

DEFAULT_BYTES, MOST_BYTES = 64 << 20, 256 << 20
KINDS = ("gpx", "fit")


@dataclass(frozen=True)
class Ingested:
    """``outcomes``: source_id, outcome, code, content_sha256; samples and parts of the sources that parse."""

    outcomes: DataFrame
    samples: DataFrame
    parts: DataFrame


def read_files(spark: SparkSession, path: str, max_source_bytes: int = DEFAULT_BYTES) -> DataFrame:
    """(source_id, kind, revision_id, content, length). Files over the budget come without content: they are never read in part."""
    if type(max_source_bytes) is not int or not 1 <= max_source_bytes <= MOST_BYTES:
        raise ValueError("the budget is a number of bytes up to 256 MiB")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = raw.select("path", "length")
    small = raw.filter(F.col("length") <= max_source_bytes).select("path", "length", "content")
    large = sizes.filter(F.col("length") > max_source_bytes).withColumn("content", F.lit(None).cast("binary"))
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return small.unionByName(large).select(F.col("path").alias("source_id"), kind.alias("kind"), F.lit("1").alias("revision_id"), "content", "length")


def ingest(sources: DataFrame) -> Ingested:
    """Normalised samples of (source_id, kind, content) with optional ``length``, ``revision_id`` and ``expected_sha256``."""
    rows = sources
    for name, kind in (("length", "bigint"), ("revision_id", "string"), ("expected_sha256", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit("1" if name == "revision_id" else None).cast(kind))
    digest = F.sha2("content", 256)
    named = F.length("source_id").between(1, 256) & F.length("revision_id").between(1, 256)
    code = (
        F.when(~F.coalesce(named, F.lit(False)), "INVALID_TRACK_SOURCE_REFERENCE")
        .when(F.col("content").isNull() & F.col("length").isNotNull(), "SOURCE_BYTES_LIMIT_EXCEEDED")
        .when(F.col("content").isNull(), "SOURCE_READ_FAILED")
        .when(F.col("expected_sha256").isNotNull() & (~is_sha256(F.col("expected_sha256")) | (F.col("expected_sha256") != digest)), "SOURCE_HASH_MISMATCH")
        .when(~F.col("kind").isin(*KINDS), "UNSUPPORTED_SOURCE_KIND")
    )
    rows = rows.withColumns({"code": code, "content_sha256": digest})
    good = rows.filter("code IS NULL").select("source_id", "kind", "content")
    gpx_failures, gpx_samples, parts = parse_gpx(good.filter("kind = 'gpx'"))
    fit_failures, fit_samples = parse_fit(good.filter("kind = 'fit'"))
    samples = gpx_samples.unionByName(fit_samples)
    failures = gpx_failures.unionByName(fit_failures).withColumnRenamed("code", "parse_code")
    said = normalize.outcomes(samples).withColumnRenamed("track_id", "source_id")
    every = rows.select("source_id", "code", "content_sha256").join(failures, "source_id", "left").join(said, "source_id", "left")
    failed = F.coalesce("code", "parse_code")
    outcome = F.when(failed.isNotNull(), "failure").otherwise(F.coalesce("outcome", F.lit("no_positioned_observations")))
    outcomes = every.select("source_id", outcome.alias("outcome"), failed.alias("code"), "content_sha256")
    return Ingested(outcomes, samples, parts.unionByName(fit_samples.select("track_id", "part_ord").distinct()))
