"""Words, lines and their hashes, vectorised over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, lower-cased in A-Z only.  The hash of a byte run
is a polynomial over random byte values modulo 2^64, taken from prefix sums, and then mixed; every routine works
on whole texts in pieces of bounded size (one document at least).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_rng = np.random.RandomState(20240117)
_VALUE = _rng.randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        n = max(n, (1 << 19) + 1)
        for k, base in (("p", _P), ("q", _PI)):
            a = np.full(n, np.uint64(base), np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


@dataclass
class Piece:
    """Rows first..last of a column: their bytes, the runs in them with hashes, and each row's share of the runs."""

    first: int
    last: int
    data: np.ndarray
    rows: np.ndarray  # byte offsets of the rows
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # runs of row r: bounds[r] .. bounds[r + 1]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes; null is as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def hashed(b: np.ndarray, borders: np.ndarray, apart: np.ndarray = SPACE, value: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of bytes that are not apart; a run ends at a border as well."""
    m = len(b)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sep = apart[b]
    before, after = np.empty(m, bool), np.empty(m, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = sep[:-1], sep[1:]
    inner = borders[(borders > 0) & (borders < m)]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(before & ~sep), np.flatnonzero(after & ~sep) + 1
    p, q = _powers_to(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(value[b] * p[:m], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * q[starts])


def pieces(col: pa.Array, apart: np.ndarray = SPACE, lower: bool = True, size: int = 1 << 19) -> Iterator[Piece]:
    offs, data = utf8(col)
    n, i = len(offs) - 1, 0
    value = _VALUE_LOWER if lower else _VALUE
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        b, rows = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, hashes = hashed(b, rows[1:-1], apart, value)
        yield Piece(i, j, b, rows, starts, ends, hashes, np.searchsorted(starts, rows))
        i = j


def run_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return mix(out + np.uint64(k))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A document's k-word shingle hashes in order; with fewer words the whole sequence as one, without words none."""
    if not len(hashes):
        return hashes
    return run_hash(hashes, min(k, len(hashes)))
