"""Vectorised words and word shingles over the UTF-8 bytes of whole texts.

Texts are handled in runs of about CHUNK_BYTES, so memory is bounded by that or by the longest
single text. Bytes of multi-byte characters are all above 0x7F and so never count as separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U = np.uint64


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.int64)
LOWER[65:91] = LOWER[97:123]  # A-Z count as a-z
PLACES = 64  # of a word's bytes, whose values are in a table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _values(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A random number for each place in a word and byte there."""
    return mix(mix((places.astype(np.uint64) << U(8)) + letters.astype(np.uint64) + U(0x9E3779B97F4A7C15)) ^ U(0xD6E8FEB86659FD93))


VALUES = _values(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256), PLACES))


def text_runs(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in them) of runs of rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string()) if column.type not in (pa.large_string(), pa.large_binary()) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal stretches without separators."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    sep = separator[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, sep[:-1]
    after[-1], after[:-1] = True, sep[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z: the sum of a random number for each place and byte (tabulation hashing).

    Two different words are equal by chance only, whatever their structure.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
    letters = LOWER[data[place + np.repeat(starts, n)]]
    if int(n.max()) <= PLACES:
        values = VALUES[place << 8 | letters]
    else:
        values = VALUES[np.minimum(place, PLACES - 1) << 8 | letters]
        far = np.flatnonzero(place >= PLACES)
        values[far] = _values(place[far], letters[far])
    return mix(np.add.reduceat(values, first) + n.astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct k-word shingles, sorted within the row, and the rows' bounds in them.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    w = word_hashes(data, starts, ends)
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    m = max(0, len(w) - k + 1)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = h * U(0xD6E8FEB86659FD93) + w[j : j + m]
    fits = row[:m] == row[k - 1 :] if m else np.zeros(0, bool)
    h, owner = mix(h[fits] ^ U(k)), row[:m][fits]
    if (short := np.flatnonzero((n > 0) & (n < k))).size:
        more = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            x = 0
            for y in w[first[r] : first[r + 1]].tolist():
                x = (x * 0xD6E8FEB86659FD93 + y) % 2**64
            more[i] = x
        h, owner = np.concatenate([h, mix(more ^ n[short].astype(np.uint64))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        bounds = np.searchsorted(owner, np.arange(rows + 1))
    return h, bounds
