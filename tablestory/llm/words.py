"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow column.

A word is a longest run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z are read in lower
case. White space and A-Z are single bytes in UTF-8, so bytes and characters agree.
Texts are taken in groups of some megabytes, a longer text alone, in pieces cut at white
space, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII signs, for words without punctuation.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_OF = _BYTE[_LOWER]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(20, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                made = np.full(size, base, np.uint64)
                made[0] = 1
                _powers[name] = np.multiply.accumulate(made)
    return _powers["up"], _powers["down"]


def plain(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes; a longer row comes alone."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = max(at + 1, min(to, len(offsets) - 1))
        yield at, to
        at = to


@dataclass
class Words:
    """The words of rows ``first`` to ``last``: word ``k`` of row ``r`` is at ``bounds[r - first] + k``."""

    first: int
    last: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.bounds[row - self.first]:self.bounds[row - self.first + 1]]


def _piece(data: np.ndarray, edges: np.ndarray, gaps: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of some bytes; edges: where a new row begins."""
    n = len(data)
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        word = np.zeros(n + 2, bool)
        np.logical_not(gaps[data], out=word[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[edges] = True
        starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
        ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[data] * up[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts]
        return starts, ends, mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(column: pa.Array | pa.ChunkedArray, limit: int = GROUP_BYTES, gaps: np.ndarray = SPACE, lower: bool = True) -> Iterator[Words]:
    """The words of a text column, group by group; starts and ends are byte places in the column's data.

    ``gaps`` tells which bytes part words; without ``lower``, A-Z differ from a-z.
    """
    data, offsets = plain(column)
    for first, last in groups(offsets, limit):
        low, high = int(offsets[first]), int(offsets[last])
        parts, at = [], low
        while at < high or not parts:
            to = high
            if last - first == 1 and high - at > 2 * limit:
                to = at + limit
                while to < high and not gaps[data[to]]:
                    spaces = np.flatnonzero(gaps[data[to:to + limit]])
                    to = to + int(spaces[0]) if len(spaces) else min(high, to + limit)
            edges = offsets[first:last + 1] - at if to == high and at == low else np.zeros(0, np.int64)
            starts, ends, found = _piece(data[at:to], edges, gaps, _BYTE_OF if lower else _BYTE)
            parts.append((starts + at, ends + at, found))
            at = to
            if low == high:
                break
        starts, ends, found = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        bounds = np.searchsorted(starts, offsets[first:last + 1])
        yield Words(first, last, bounds, found, starts, ends)


def shingle_rows(w: Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every row its distinct shingles, sorted: hashes of runs of ``size`` words.

    A row with fewer words has one shingle, the whole of it; one without words has none.
    """
    with np.errstate(over="ignore"):
        n = len(w.hashes)
        run = np.full(max(n - size + 1, 0), size, np.uint64)
        for k in range(size):
            run += w.hashes[k:n - size + 1 + k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1) if len(run) else 0
        run = mix(run)
        for row in range(w.first, w.last):
            low, high = int(w.bounds[row - w.first]), int(w.bounds[row - w.first + 1])
            if high - low >= size:
                found = np.sort(run[low:high - size + 1])
                yield row, found[np.append(True, found[1:] != found[:-1])]
            elif high > low:
                whole = np.full(1, high - low, np.uint64)
                for k in range(high - low):
                    whole = mix(whole + w.hashes[low + k] * np.uint64(2 * k + 3))
                yield row, whole
            else:
                yield row, run[:0]
