"""Hashes of words, computed over whole Arrow batches with NumPy.

The bytes of a batch are taken in blocks that end between words.  A running polynomial sum over a
block gives every word's hash as a difference of two sums, so the cost is a few array operations a
byte and no Python work for a word.  Letters A-Z are lower-cased by the byte table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a block.
BLOCK = 1 << 20

#: Bytes of the texts that operators hash at once.
SLICE = 1 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def _values() -> np.ndarray:
    """A random-looking odd value for each byte; A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
    v[65:91] = v[97:123]
    return v


VALUES = _values()

#: Bytes of a word: all but ASCII white space; letters, digits and bytes beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))]) for base in (MULTIPLIER, np.uint64(_inverse(int(MULTIPLIER))))]
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch):
    """Parts of a batch with about SLICE bytes of text (its last column) each."""
    start, size = 0, 0
    column = batch.column(batch.num_columns - 1)
    for i, n in enumerate(np.diff(text_bytes(column)[1]).tolist()):
        size += n
        if size >= SLICE:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and n + 1 places where each text's words begin."""
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):  # end between words: at a text's end or behind a separator
            stop = offsets[np.searchsorted(offsets, end, "right") - 1]
            if stop <= at:  # one text fills the block
                close = int(offsets[np.searchsorted(offsets, at, "right")])
                gaps = np.flatnonzero(~word[raw[at:end]])
                while not len(gaps) and end < close:
                    at_, end = end, min(close, end + BLOCK)
                    gaps = np.flatnonzero(~word[raw[at_:end]]) + (at_ - at)
                stop = at + gaps[-1] + 1 if len(gaps) else close
            end = int(stop)
        part = raw[at:end]
        inside = word[part]
        before = np.zeros(len(part) + 1, bool)
        before[1:] = inside
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        first = inside & ~before[:-1]
        first[cuts] = inside[cuts]
        last = np.zeros(len(part), bool)
        last[:-1] = ~inside[1:]
        last[-1:] = True
        last[cuts[cuts > 0] - 1] = True
        start, stop = np.flatnonzero(first), np.flatnonzero(last & inside)
        power, back = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[stop + 1] - sums[start]) * back[start] + (stop + 1 - start).astype(np.uint64)))
        places.append(start + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def grams(words: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of each text, and n + 1 places where each text's begin."""
    if n == 1:
        return words, begins
    count = np.maximum(np.diff(begins) - (n - 1), 0)
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    take = np.repeat(begins[:-1] - out[:-1], count) + np.arange(out[-1])
    x = words[take]
    for i in range(1, n):
        x = x * MULTIPLIER + words[take + i]
        x ^= x >> np.uint64(29)
    return mix(x), out
