"""Words of whole Arrow batches as 64-bit hashes, computed on the UTF-8 buffers without Python strings.

A word is a run of bytes that are ASCII digits, ASCII letters (A-Z folded to a-z) or above 0x7F: in
UTF-8 exactly the matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in the text with A-Z lower-cased.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time. Bounds the temporary arrays, not the texts.
BLOCK = 1 << 17

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit words, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 20)) * U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(n - 1, 0), base, U)]))


class Words(NamedTuple):
    """Words of a batch: row ``r`` has the words ``first[r]:first[r + 1]``, word ``w`` the bytes ``start[w]:end[w]`` of ``data``."""

    data: np.ndarray
    rows: np.ndarray  # byte offsets of the rows
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


#: Bytes of texts that an operator takes from a batch at a time. Bounds the temporary arrays; a longer text is taken alone.
SLICE = 1 << 22


def cuts(*columns: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows whose texts in all columns together have about ``SLICE`` bytes at most; one range for an empty batch."""
    total = sum((np.diff(buffers(column)[1]) for column in columns), np.zeros(len(columns[0]), np.int64))
    part = np.cumsum(total) // SLICE
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(total)]
    return list(zip(at[:-1], at[1:], strict=True))


def slices(texts: pa.Array) -> list[pa.Array]:
    return [texts[low:high] for low, high in cuts(texts)]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 0x41) & (code <= 0x5A)
    word = upper | ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80)
    values = constants(256, 7)
    values[0x41:0x5B] = values[0x61:0x7B]
    return word, values, upper


IS_WORD, VALUES, _ = _tables()


def batch_words(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of a batch; ``hash`` has a further column for each prefix length in bytes, 0 where the word is no longer than that."""
    data, rows = buffers(texts)
    is_word = IS_WORD[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    inner = rows[1:-1]
    before[inner[inner < len(data)]] = False
    begins = is_word & ~before
    start = np.flatnonzero(begins)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = is_word[1:] & ~begins[1:]
    end = np.flatnonzero(is_word & ~after) + 1
    first = np.searchsorted(start, rows)
    hashes = np.empty((len(start), 1 + len(prefixes)), U)
    with np.errstate(over="ignore"):
        low = 0
        while low < len(start):
            high = max(low + 1, int(np.searchsorted(start, start[low] + BLOCK)))
            size = end[low:high] - start[low:high]
            at = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(at, size)
            chars = data[start[low] : end[high - 1]][is_word[start[low] : end[high - 1]]]
            values = VALUES[chars] * powers(0x9E3779B97F4A7C15, int(size.max()))[inside]
            hashes[low:high, 0] = np.add.reduceat(values, at)
            for column, length in enumerate(prefixes, 1):
                part = np.add.reduceat(np.where(inside < length, values, U(0)), at)
                hashes[low:high, column] = np.where(size > length, part + U(length), U(0))
            low = high
        hashes = mix(hashes)
    return Words(data, rows, start, end, hashes if prefixes else hashes[:, 0], first)


def per_row(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    """``ufunc`` reduced over each row's values; ``empty`` for rows without any."""
    out = np.full(len(first) - 1, empty, values.dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = ufunc.reduceat(values, first[some])
    return out
