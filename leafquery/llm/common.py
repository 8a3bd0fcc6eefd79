"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, key): the whole row as a struct, and a key that repeated rows share.

    The key is (id, 64-bit hash of the text), so rows with one id but different texts stay apart,
    and equal rows get equal answers. A null text is the empty text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"),
                       row_key(F.col(id_col), text).alias("key"))


def row_key(id_col: Column, text: Column) -> Column:
    return F.struct(id_col.alias("id"), F.xxhash64(text).alias("hash"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """(first, last) document of consecutive slices of at most ``most`` bytes, or of one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_BLOCK + 1, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, first): words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as 64-bit hashes.

    ``between`` marks the bytes between words, if others are meant.

    ``starts`` are byte positions in ``buf``; the words of document i are first[i]:first[i+1].
    Works block by block, so that memory follows the number of words and not eight bytes a byte.
    """
    white = between[buf]
    is_start = ~white
    is_start[1:] &= white[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    is_start[begins] = ~white[begins]
    starts = np.flatnonzero(is_start)
    # a word ends before the next white byte, the next document, or the end
    stop = white.copy()
    stop[begins] = True
    bounds = np.append(np.flatnonzero(stop), len(buf))
    ends = bounds[np.searchsorted(bounds, starts, "right")] if len(starts) else starts
    power, inverse = _powers()
    hashes = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if b <= a:  # one word longer than a block: chained over its blocks
            h = np.uint64(0)
            for p in range(base, ends[a], _BLOCK):
                part = _LOWER[buf[p:min(p + _BLOCK, ends[a])]].astype(np.uint64) + np.uint64(1)
                h = mix(np.atleast_1d(h * np.uint64(31) + (part * power[:len(part)]).sum(dtype=np.uint64)))[0]
            hashes[a] = h
            a += 1
            continue
        part = _LOWER[buf[base:ends[b - 1]]].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[:len(part)], dtype=np.uint64)])
        s, e = starts[a:b] - base, ends[a:b] - base
        hashes[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    first = np.searchsorted(starts, offsets)
    return starts, hashes, first


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words; one shorter result for a shorter input is left to the caller."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, seed + 0x2545F491, np.uint64)
    for j in range(width):
        h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)
