"""FIT activity files from samples, for exchange and for tests."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.functions.scalars import SEMICIRCLE, utc_seconds
from groundtrace.sources.fit import ACTIVITY, EPOCH, FILE_ID, RECORD, crc16, in_parts

#: Fields of a written record: number, size, base type.
RECORD_LAYOUT = ((253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85))
NO_TIME, NO_POSITION = 0xFFFFFFFF, 0x7FFFFFFF


def definition(local: int, message: int, fields: Iterable[tuple[int, int, int]], big: bool = False) -> bytes:
    fields = list(fields)
    return struct.pack(">BBBHB" if big else "<BBBHB", 0x40 | local, 0, int(big), message, len(fields)) + b"".join(bytes(f) for f in fields)


def wrapped(body: bytes, head: int = 14) -> bytes:
    """Header, messages and checksums."""
    first = struct.pack("<BBHI4s", head, 0x20, 2100, len(body), b".FIT")
    whole = first + (struct.pack("<H", crc16(first)) if head == 14 else b"") + body
    return whole + struct.pack("<H", crc16(whole))


def activity(records: Iterable[tuple[int | None, int | None, int | None]], big: bool = False) -> bytes:
    """A file of (FIT time, latitude, longitude in semicircles) records; None is written as the invalid value."""
    order = ">" if big else "<"
    body = definition(0, FILE_ID, [(0, 1, 0x00)], big) + bytes([0, ACTIVITY]) + definition(1, RECORD, RECORD_LAYOUT, big)
    for time, lat, lon in records:
        body += struct.pack(order + "BIii", 1, NO_TIME if time is None else time, NO_POSITION if lat is None else lat, NO_POSITION if lon is None else lon)
    return wrapped(body)


def fit_files(samples: DataFrame) -> DataFrame:
    """(source_id, kind, content) of tracks. Times are cut to whole seconds, positions to semicircles."""
    row = F.struct(
        "part_ord", "sample_ord", (F.floor(utc_seconds(F.col("ts_text"))) - EPOCH).cast("long").alias("time"),
        F.rint(F.col("lat") / SEMICIRCLE).cast("long").alias("lat"), F.rint(F.col("lon") / SEMICIRCLE).cast("long").alias("lon"),
    )

    def write(tracks: pa.Array) -> pa.Array:
        return in_parts(tracks, lambda some: pa.array([activity((r["time"], r["lat"], r["lon"]) for r in rows) for rows in some], pa.binary()), pa.binary())

    whole = samples.groupBy("track_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return whole.select(F.col("track_id").cast("string").alias("source_id"), F.lit("fit").alias("kind"), F.arrow_udf(write, "binary")("rows").alias("content"))
