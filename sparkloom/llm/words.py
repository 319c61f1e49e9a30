"""Words of UTF-8 texts as 64-bit hashes, vectorised over Arrow columns.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r, which is
the same as a run of other characters, since UTF-8 never uses these bytes inside
a longer character. A word's hash is the sum of one scrambled value per byte and
place, scrambled again with its length. Equal words have equal hashes. Values of
different places have nothing in common, so no pattern of letters makes two words meet, as a polynomial
modulo a power of two does for long enough ones; different words share a hash with a chance of
about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_BYTE_CODES = np.random.RandomState(7).randint(0, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; a word never crosses a place in ``firsts``."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = firsts[(firsts > 0) & (firsts < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after)
    letters = np.flatnonzero(inside)
    lengths = ends - starts + 1
    firsts_of = np.cumsum(lengths) - lengths  # where each word begins among the letters
    place = np.arange(len(letters), dtype=np.uint64) - np.repeat(firsts_of.astype(np.uint64), lengths)
    values = mix(_BYTE_CODES[data[letters]] + place * _PLACE)
    whole = np.add.reduceat(values, firsts_of) if len(starts) else np.empty(0, np.uint64)
    return mix(whole + lengths.astype(np.uint64) * _STEP), starts


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, taken in pieces that end at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[end : end + SLICE_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + SLICE_BYTES)
        found.append(_hash_words(data[at:end], np.empty(0, np.int64))[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return places, raw


def word_slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, number of words per row) for runs of rows.

    A run holds about ``SLICE_BYTES`` of text, so memory stays bounded whatever the batch.
    """
    places, raw = text_buffer(column)
    row, rows = 0, len(places) - 1
    while row < rows:
        last = int(np.searchsorted(places, places[row] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), rows)
        data = raw[places[row] : places[last]]
        if lower:
            data = _LOWER[data]
        if last == row + 1 and len(data) > SLICE_BYTES:
            hashes = _long_text(data)
            yield row, last, hashes, np.array([len(hashes)])
        else:
            firsts = places[row : last + 1] - places[row]
            hashes, starts = _hash_words(data, firsts[:-1])
            counts = np.diff(np.searchsorted(starts, firsts, side="left"))
            yield row, last, hashes, counts
        row = last


def gram_hashes(hashes: np.ndarray, k: int, tag: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive values, also across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(tag * 2 + 1), np.uint64)
    for j in range(k):
        total = total * _STEP + hashes[j : j + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
