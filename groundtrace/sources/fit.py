"""FIT activity files, decoded from the published record layout with ``struct``.

A file is a 12 or 14 byte header, definition and data messages and a CRC-16. Both byte orders, compressed
time stamps and developer fields are read; only ``record`` messages are kept, in their order.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.functions.scalars import in_domain, semicircles, utc_text

#: Seconds from 1970 to the epoch of FIT times; smaller values than the second are relative times.
EPOCH, LEAST_TIME = 631_065_600, 0x10000000
FILE_ID, RECORD, ACTIVITY = 0, 20, 4
#: Files whose records are Python objects at the same time.
FILES_AT_ONCE = 64
# The published protocol's table of checksums of four bits.
CRC_NIBBLES = (0x0000, 0xCC01, 0xD801, 0x1400, 0xF001, 0x3C00, 0x2800, 0xE401, 0xA001, 0x6C00, 0x7800, 0xB401, 0x5000, 0x9C01, 0x8801, 0x4400)
# Fixed values of the format: base type -> (struct code, invalid value).
BASE_TYPES = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF),
    0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0),
}
#: Fields of a record: number -> (name, scale, offset).
RECORD_FIELDS = {253: ("timestamp", None, 0), 0: ("lat", None, 0), 1: ("lon", None, 0), 2: ("altitude", 5, 500), 5: ("distance", 100, 0), 6: ("speed", 1000, 0), 73: ("enhanced_speed", 1000, 0), 78: ("enhanced_altitude", 5, 500)}


def crc16(data: bytes, crc: int = 0) -> int:
    for byte in data:
        for nibble in (byte & 15, byte >> 4):
            crc = (crc >> 4) ^ CRC_NIBBLES[crc & 15] ^ CRC_NIBBLES[nibble]
    return crc


class FitError(ValueError):
    """``args[0]`` is the code of what is wrong."""


@dataclass
class _Definition:
    message: int
    order: str
    fields: list[tuple[int, int, int]]
    size: int = field(default=0)


def _value(raw: bytes, order: str, base: int) -> int | None:
    if base not in BASE_TYPES:
        return None
    code, invalid = BASE_TYPES[base]
    if len(raw) != struct.calcsize(code):
        return None
    value = struct.unpack(order + code, raw)[0]
    return None if value == invalid else value


def decode(data: bytes, counts: Counter[int] | None = None) -> list[dict]:
    """Records as dicts of raw values; ``has_position`` tells whether both fields are there, valid or not.

    ``counts`` gets the number of data messages by message number.
    """
    if len(data) < 14 or data[0] not in (12, 14) or data[8:12] != b".FIT":
        raise FitError("MALFORMED_SOURCE")
    head, body = data[0], struct.unpack_from("<I", data, 4)[0]
    if head == 14 and (stated := struct.unpack_from("<H", data, 12)[0]) and stated != crc16(data[:12]):
        raise FitError("FIT_CRC_MISMATCH")
    end = head + body
    if len(data) < end + 2:
        raise FitError("MALFORMED_SOURCE")
    if struct.unpack_from("<H", data, end)[0] != crc16(data[:end]):
        raise FitError("FIT_CRC_MISMATCH")
    if len(data) > end + 2:
        raise FitError("UNSUPPORTED_FIT_MULTIPLE_FILES" if data[end + 10 : end + 14] == b".FIT" else "MALFORMED_SOURCE")
    definitions: dict[int, _Definition] = {}
    records, at, time, file_ids = [], head, None, 0
    try:
        while at < end:
            header = data[at]
            at += 1
            local = (header >> 5) & 3 if header & 0x80 else header & 15
            if not header & 0x80 and header & 0x40:
                order = ">" if data[at + 1] else "<"
                message, n = struct.unpack_from(order + "HB", data, at + 2)
                fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
                at += 5 + 3 * n
                extra = 0
                if header & 0x20:
                    more = data[at]
                    extra = sum(data[at + 2 + 3 * k] for k in range(more))
                    at += 1 + 3 * more
                definitions[local] = _Definition(message, order, fields, extra)
                continue
            if local not in definitions:
                raise FitError("MALFORMED_SOURCE")
            own = definitions[local]
            values, named = {}, set()
            for number, size, base in own.fields:
                if at + size > end:
                    raise FitError("MALFORMED_SOURCE")
                named.add(number)
                values[number] = _value(data[at : at + size], own.order, base)
                at += size
            at += own.size
            if values.get(253) is not None:
                time = values[253]
            elif header & 0x80 and time is not None:
                time += ((header & 31) - time) & 31
                values[253] = time
            if counts is not None:
                counts[own.message] += 1
            if not file_ids and own.message != FILE_ID:
                raise FitError("FIT_FILE_ID_MISSING")
            if own.message == FILE_ID:
                file_ids += 1
                if file_ids > 1 or values.get(0) != ACTIVITY:
                    raise FitError("UNSUPPORTED_FIT_FILE_TYPE")
            elif own.message == RECORD:
                record = {name: values.get(k) if scale is None or values.get(k) is None else values[k] / scale - shift for k, (name, scale, shift) in RECORD_FIELDS.items()}
                records.append(record | {"has_position": {0, 1} <= named})
    except (struct.error, IndexError) as problem:
        raise FitError("MALFORMED_SOURCE") from problem
    if at != end:
        raise FitError("MALFORMED_SOURCE")
    if not file_ids:
        raise FitError("FIT_FILE_ID_MISSING")
    return records


_FIELDS = [("timestamp", pa.int64()), ("lat", pa.int64()), ("lon", pa.int64()), *[(n, pa.float64()) for n in ("altitude", "distance", "speed", "enhanced_speed", "enhanced_altitude")], ("has_position", pa.bool_())]
_SQL = "struct<code: string, records: array<struct<timestamp: bigint, lat: bigint, lon: bigint, altitude: double, distance: double, speed: double, enhanced_speed: double, enhanced_altitude: double, has_position: boolean>>>"


def fit_records(content: Column) -> Column:
    """struct(code, records) of a file's bytes."""
    kind = pa.struct([("code", pa.string()), ("records", pa.list_(pa.struct(_FIELDS)))])

    def one(data: bytes | None) -> dict | None:
        try:
            return {"code": None, "records": decode(bytes(data))} if data is not None else None
        except FitError as problem:
            return {"code": problem.args[0], "records": None}

    def read(files: pa.Array) -> pa.Array:
        return in_parts(files, lambda some: pa.array([one(data) for data in some], kind), kind)

    return F.arrow_udf(read, _SQL).asNondeterministic()(content)  # so that a filter on the code doesn't decode again


def in_parts(values: pa.Array, work: Callable[[list], pa.Array], kind: pa.DataType) -> pa.Array:
    """``work`` of a few values at a time: only these are Python objects at once."""
    found = [work(values.slice(at, FILES_AT_ONCE).to_pylist()) for at in range(0, len(values), FILES_AT_ONCE)]
    return pa.concat_arrays([pa.array([], kind), *found])


def message_counts(content: Column) -> Column:
    """map(message number -> data messages) of a file's bytes, null for a file that can't be read."""

    def count(files: pa.Array) -> pa.Array:
        out = []
        for data in files.to_pylist():
            found: Counter[int] = Counter()
            try:
                decode(bytes(data or b""), found)
                out.append(sorted(found.items()))
            except FitError:
                out.append(None)
        return pa.array(out, pa.map_(pa.int32(), pa.int64()))

    return F.arrow_udf(count, "map<int, bigint>")(content)


def parse_fit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failures: source_id, code; samples) of (source_id, content). A record that can't be an observation fails its file."""

    def wrong(r: Column) -> Column:
        lon, lat = semicircles(r["lon"]), semicircles(r["lat"])
        placed = r["lon"].isNotNull() & r["lat"].isNotNull()
        return F.when(placed & ~in_domain(lon, lat), "POSITION_OUT_OF_RANGE").when(placed & ((r["distance"] < 0) | (F.coalesce(r["enhanced_speed"], r["speed"]) < 0)), "INVALID_OBSERVATION_VALUE")

    rows = files.select("source_id", fit_records(F.col("content")).alias("f"))
    rows = rows.withColumn("code", F.coalesce("f.code", F.get(F.filter(F.transform("f.records", wrong), lambda c: c.isNotNull()), F.lit(0))))
    each = rows.filter("code IS NULL").select(F.col("source_id").alias("track_id"), F.posexplode_outer("f.records").alias("record_index", "r")).filter("r IS NOT NULL")
    lon, lat = semicircles(F.col("r.lon")), semicircles(F.col("r.lat"))
    placed = F.col("r.lon").isNotNull() & F.col("r.lat").isNotNull()
    relative = F.col("r.timestamp") < LEAST_TIME
    samples = each.select(
        "track_id", F.lit(0).alias("part_ord"), F.col("record_index").cast("long").alias("sample_ord"), F.col("record_index").cast("long").alias("record_index"),
        F.when(placed, lon).alias("lon"), F.when(placed, lat).alias("lat"),
        F.when(~placed, F.when(F.col("r.has_position"), "POSITION_INVALID_SENTINEL").otherwise("POSITION_MISSING")).alias("position_code"),
        F.when(placed & ~relative, F.replace(utc_text((F.col("r.timestamp") + EPOCH) * 1_000_000), F.lit(".000000"), F.lit(""))).alias("ts_text"),
        F.when(placed & relative, "TIMESTAMP_RELATIVE").alias("ts_code"),
        F.when(placed, F.coalesce("r.enhanced_altitude", "r.altitude")).alias("altitude_m"), F.when(placed, F.col("r.distance")).alias("distance_m"),
        F.when(placed, F.coalesce("r.enhanced_speed", "r.speed")).alias("observed_speed_mps"),
    )
    return rows.select("source_id", "code").filter("code IS NOT NULL"), samples
