"""Byte-level text kernels: every operator here reads Arrow string columns as
UTF-8 buffers and works on them with numpy, a bounded slice at a time.

Words are maximal runs of ``[0-9a-z]`` and bytes >= 0x80 after lower-casing.
A shingle is the 64-bit hash of five consecutive words of one text; a text of
one to four words has one shingle, made of all its words; a text without words
has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text a kernel holds at once; a longer single text makes its own slice.
SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SHIFT, _M1, _M2 = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _SHIFT)
    x *= _M1
    x ^= x >> _SHIFT
    x *= _M2
    x ^= x >> _SHIFT
    return x


def keyed(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (1 << 64) - 1))


def slices(column, limit: int = SLICE_BYTES, lower: bool = False):
    """Yields (first row, end row, bytes, offsets) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    column = pc.fill_null(column, b"" if column.type == pa.binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = column.slice(lo, hi - lo)
        if lower:
            part = pc.utf8_lower(part)
        at = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = part.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        yield lo, hi, buf, at - at[0]
        lo = hi


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of which the hash of any substring can be read."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    values = buf.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(len(buf))[0]
    np.cumsum(values, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def runs(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text offsets of the maximal runs of equal non-zero kind."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offs[:-1][offs[:-1] < n]] = True
    firsts = np.flatnonzero(edge)
    lasts = np.append(firsts[1:], n)
    real = kind[firsts] != 0
    starts, ends = firsts[real], lasts[real]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of lower-cased texts, and the words' offsets per text."""
    starts, ends, at = runs(WORD_BYTE[buf], offs)
    return span_hash(prefix_hash(buf), starts, ends), at


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order with their offsets per text."""
    words, at = word_hashes(buf, offs)
    counts = np.diff(at)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(per)])
    first = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], per)
    length = np.repeat(np.minimum(counts, n), per)
    out = np.zeros(len(first), np.uint64)
    for k in range(n):
        live = length > k
        if live.all():
            out = out * np.uint64(_INVERSE) + words[first + k]
        else:
            out[live] = out[live] * np.uint64(_INVERSE) + words[first[live] + k]
    return mix(out + length.astype(np.uint64)), out_at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def segments(at: np.ndarray) -> np.ndarray:
    """The text number of every element, from offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
