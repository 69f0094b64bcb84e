"""Media columns: AVI files of motion JPEG, read back through their RIFF index, with shots as timed clips.

Payload bytes are stored as samples of baseline JPEG frames, one 8x8 block of one grey level for each
byte. A flat block has a DC coefficient only; with a DC quantiser of 8 that is the level less 128, so that
the stored byte comes back exactly. The Huffman table gives category c (0 to 8) a code of 15 - c bits, and
the end-of-block code has one bit: every block takes 16 bits, whole rows of blocks are coded and decoded
as arrays, and neither byte of a block can be 0xFF. Frames with other tables or with AC coefficients go
through a sequential decoder.

Shots: the histograms of neighbouring frames are compared; a cut is a difference over ``CUT_LEAST`` and
over the mean plus ``CUT_SIGMAS`` deviations of those of the ``CUT_WINDOW`` differences before it that are
no cuts themselves. Where there are none, ``CUT_LEAST`` alone decides.

Defined results: a null text is stored as an empty one, which is one unit of zero bytes; equal texts have
equal files. A RIFF file ends before 4 GiB; a payload that would not fit raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload bytes in a row of blocks, and rows of blocks in a frame at most.
UNIT, ROWS = 64, 32
FRAME_US = 40_000
BINS, CUT_SIGMAS, CUT_LEAST, CUT_WINDOW = 32, 3.0, 0.15, 8
DC_LENGTHS = {c: 15 - c for c in range(9)}
# Fixed values of the JPEG format: the zigzag order of the 64 coefficients.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)


def padded(payload: bytes) -> bytes:
    """With zero bytes up to a positive multiple of the unit."""
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a JPEG Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((code, length, symbol))
            code += 1
        at += n
        code <<= 1
    return out


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return counts, bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


@cache
def _codes() -> np.ndarray:
    """The 16 bits of a block for each difference of DC levels from -255 to 255."""
    code = {s: (c, n) for c, n, s in canonical(*_table(DC_LENGTHS))}
    out = np.zeros(511, np.uint16)
    for difference in range(-255, 256):
        category = abs(difference).bit_length()
        bits = difference if difference >= 0 else difference + (1 << category) - 1
        out[difference + 255] = ((code[category][0] << category) | bits) << 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def jpeg_header(rows: int) -> bytes:
    quantisers = bytes([8, *[1] * 63])
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + quantisers)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, UNIT * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + b"".join(_table(DC_LENGTHS)))
        + _segment(0xC4, b"\x10" + b"".join(_table({0: 1})))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion JPEG that holds the payload, a positive multiple of the unit."""
    if len(payload) > 1_500_000_000:
        raise ValueError("the payload doesn't fit into one RIFF file")
    rows = min(len(payload) // UNIT, ROWS)
    frames = -(-len(payload) // (rows * UNIT))
    level = np.zeros(frames * rows * UNIT, np.int16)
    level[: len(payload)] = np.frombuffer(payload, np.uint8)
    level = level.reshape(frames, rows * UNIT) - 128
    coded = _codes()[np.diff(level, axis=1, prepend=np.zeros((frames, 1), np.int16)) + 255].astype(">u2")
    head = jpeg_header(rows)
    size = len(head) + coded.shape[1] * 2 + 2
    images = np.empty((frames, 8 + size), np.uint8)
    images[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    images[:, 8 : 8 + len(head)] = np.frombuffer(head, np.uint8)
    images[:, 8 + len(head) : -2] = coded.view(np.uint8).reshape(frames, -1)
    images[:, -2:] = (0xFF, 0xD9)
    if size % 2:
        images = np.concatenate([images, np.zeros((frames, 1), np.uint8)], axis=1)
    index = np.zeros((frames, 4), "<u4")
    index[:, 0], index[:, 1] = struct.unpack("<I", b"00dc")[0], 0x10
    index[:, 2], index[:, 3] = 4 + np.arange(frames) * images.shape[1], size
    width, height = UNIT * 8, rows * 8
    main = struct.pack("<14I", FRAME_US, size * 1_000_000 // FRAME_US, 0, 0x10, frames, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, frames, size, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    info = b"INFO" + _chunk(b"ICMT", b"%d" % len(payload))
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", info) + _chunk(b"LIST", b"movi" + images.tobytes()) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def chunks(data: memoryview) -> dict[bytes, memoryview]:
    """The chunks of a RIFF list by name; lists by their type, streams' lists opened too."""
    out, at = {}, 0
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        out[bytes(body[:4]) if name in (b"LIST", b"RIFF") else name] = body
        at += 8 + size + size % 2
    return out


class Jpeg(NamedTuple):
    height: int
    width: int
    quantisers: np.ndarray  # in zigzag order
    dc: tuple[tuple[int, int, int], ...]
    ac: tuple[tuple[int, int, int], ...]
    at: int  # of the first coded byte


@cache
def parse_jpeg(head: bytes) -> Jpeg:
    """The markers of a baseline grey JPEG up to its scan."""
    at, height, width, quantisers, tables = 2, 0, 0, np.ones(64, np.int64), {}
    if head[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        marker, size = struct.unpack_from(">xBH", head, at)
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quantisers = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
        elif marker == 0xC0:
            height, width = struct.unpack_from(">xHH", body)
            if body[5] != 1:
                raise ValueError("only grey images are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = tuple(canonical(body[1:17], body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDA:
            return Jpeg(height, width, quantisers, tables[0x00], tables[0x10], at)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline images are read")


@cache
def _flat_levels(dc: tuple, ac: tuple) -> np.ndarray | None:
    """The DC difference for each 16 bits where every block of DC only takes 16 bits, else None."""
    if len(ac) != 1 or ac[0][2] != 0 or {n + c for _, n, c in dc} != {16 - ac[0][1]}:
        return None
    out = np.full(1 << 16, 1 << 14, np.int16)
    for code, n, category in dc:
        low = code << (16 - n)
        word = np.arange(low, low + (1 << (16 - n)))
        bits = (word >> ac[0][1]) & ((1 << category) - 1)
        out[word] = np.where(bits >> max(category - 1, 0), bits, bits - (1 << category) + 1) if category else 0
    return out


def _sequential(image: bytes, jpeg: Jpeg) -> np.ndarray:
    """All samples of one baseline image, block by block."""
    data = image[jpeg.at : image.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits, at = int.from_bytes(data + b"\xff" * 8, "big"), 0
    total = (len(data) + 8) * 8
    books = [{(n, c): s for c, n, s in table} for table in (jpeg.dc, jpeg.ac)]

    def take(n: int) -> int:
        nonlocal at
        at += n
        return (bits >> (total - at)) & ((1 << n) - 1)

    def symbol(book: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = (code << 1) | take(1)
            if (n, code) in book:
                return book[n, code]
        raise ValueError("a code that isn't in the table")

    def value(size: int) -> int:
        raw = take(size)
        return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1

    x = np.arange(8)
    cosine = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, 0.5**0.5, 1) / 2
    down, across = -(-jpeg.height // 8), -(-jpeg.width // 8)
    out, level = np.zeros((down * 8, across * 8)), 0
    for block in range(down * across):
        table = np.zeros(64)
        level += value(symbol(books[0]))
        table[0], k = level * jpeg.quantisers[0], 1
        while k < 64:
            s = symbol(books[1])
            if not s:
                break
            k += s >> 4
            if s & 15:
                table[ZIGZAG[k]] = value(s & 15) * jpeg.quantisers[k]
            k += 1
        y, left = divmod(block, across)
        out[y * 8 : y * 8 + 8, left * 8 : left * 8 + 8] = cosine @ table.reshape(8, 8) @ cosine.T
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: jpeg.height, : jpeg.width]


class Video(NamedTuple):
    frame_us: int
    levels: np.ndarray  # the grey level of each block, a row for each frame
    payload: bytes


def read_avi(media: bytes) -> Video:
    """The frames by the file's index, decoded to their blocks' levels, and the payload."""
    riff = chunks(memoryview(media))[b"AVI "]
    lists = chunks(riff[4:])
    frame_us = struct.unpack_from("<I", chunks(lists[b"hdrl"][4:])[b"avih"])[0]
    length = int(bytes(chunks(lists[b"INFO"][4:])[b"ICMT"]))
    index = np.frombuffer(lists[b"idx1"], "<u4").reshape(-1, 4)
    index = index[index[:, 0] == struct.unpack("<I", b"00dc")[0]].astype(np.int64)
    movie = lists[b"movi"]
    first = bytes(movie[index[0, 2] + 8 : index[0, 2] + 8 + min(index[0, 3], 4096)])
    jpeg = parse_jpeg(first[: first.index(b"\xff\xda") + 10])
    flat = _flat_levels(jpeg.dc, jpeg.ac)
    step, blocks = np.diff(index[:, 2]), -(-jpeg.height // 8) * -(-jpeg.width // 8)
    even = len({*index[:, 3].tolist()}) == 1 and len({*step.tolist()}) <= 1 and index[0, 3] == jpeg.at + 2 * blocks + 2
    levels = None
    if flat is not None and even:
        whole = np.frombuffer(movie, np.uint8)
        stride = int(step[0]) if len(step) else int(index[0, 3]) + 8
        images = np.lib.stride_tricks.as_strided(whole[int(index[0, 2]) + 8 :], (len(index), int(index[0, 3])), (stride, 1))
        if (images[:, : jpeg.at] == images[0, : jpeg.at]).all():
            coded = np.ascontiguousarray(images[:, jpeg.at : -2]).view(">u2")
            levels = np.clip(np.cumsum(flat[coded], axis=1, dtype=np.int64) * jpeg.quantisers[0] // 8 + 128, 0, 255).astype(np.uint8)
    if levels is None:
        rows = []
        for _, _, at, size in index.tolist():
            image = bytes(movie[at + 8 : at + 8 + size])
            rows.append(_sequential(image, parse_jpeg(image[: image.index(b"\xff\xda") + 10]))[::8, ::8].ravel())
        levels = np.array(rows)
    return Video(frame_us, levels, levels.tobytes()[:length])


def differences(levels: np.ndarray) -> np.ndarray:
    """Between 0 and 1 for each frame but the first: how much its histogram differs from the one before."""
    frames, blocks = levels.shape
    at = np.arange(frames)[:, None] * BINS + (levels >> 3)
    histograms = np.bincount(at.ravel(), minlength=frames * BINS).reshape(frames, BINS)
    return np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * blocks)


def clips(video: Video) -> list[tuple[int, int, float]]:
    """(begin, end, difference at its begin) of each shot, in milliseconds."""
    change = differences(video.levels)
    cuts = [(0, 0.0)]
    steady = np.ones(len(change), bool)
    for t, value in enumerate(change.tolist(), 1):
        window = slice(max(0, t - 1 - CUT_WINDOW), t - 1)
        before = change[window][steady[window]]
        if value > CUT_LEAST and (not len(before) or value > before.mean() + CUT_SIGMAS * before.std()):
            cuts.append((t, value))
            steady[t - 1] = False
    ends = [t for t, _ in cuts[1:]] + [len(video.levels)]
    return [(a * video.frame_us // 1000, b * video.frame_us // 1000, v) for (a, v), b in zip(cuts, ends, strict=True)]


def media(text: Column | str) -> Column:
    """The AVI file of a text's UTF-8 bytes."""
    return F.arrow_udf(lambda texts: pa.array([write_avi(padded((t.as_py() or "").encode())) for t in texts], pa.binary()), "binary")(text)


def media_clips(files: Column | str) -> Column:
    """The clips of an AVI file: array of struct(begin_ms, end_ms, difference); explode it for clip rows."""
    kind = pa.list_(pa.struct([("begin_ms", pa.int64()), ("end_ms", pa.int64()), ("difference", pa.float64())]))

    def find(data: pa.Array) -> pa.Array:
        out = [None if d.as_py() is None else [dict(zip(("begin_ms", "end_ms", "difference"), c, strict=True)) for c in clips(read_avi(d.as_py()))] for d in data]
        return pa.array(out, kind)

    return F.arrow_udf(find, "array<struct<begin_ms: bigint, end_ms: bigint, difference: double>>")(files)


DIGEST = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}


def digest(text: str | None) -> tuple[int, int, str, int, int, str, str]:
    raw = (text or "").encode()
    stored = write_avi(padded(raw))
    video = read_avi(stored)
    shots = clips(video)
    tail = zlib.crc32(video.payload[-UNIT:])
    feature = f"frames={len(video.levels)} clips={len(shots)} last_ms={shots[-1][0]}-{shots[-1][1]} peak={max(s[2] for s in shots):.4f}"
    return len(raw), len(video.payload), hashlib.sha256(video.payload).hexdigest(), tail, len(stored), hashlib.sha256(stored).hexdigest(), feature


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes, reads back and digests one file after another: no more than one is held at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digests(texts: pa.Array) -> pa.Array:
        rows = [digest(t.as_py()) for t in texts]
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(DIGEST.values())], [*DIGEST])

    kind = "struct<" + ", ".join(f"{n}: {k}" for n, k in DIGEST.items()) + ">"
    return docs.select("doc_id", F.arrow_udf(digests, kind)("text").alias("d")).select("doc_id", "d.*")
