"""Whole texts as one array of bytes: slices of bounded size, words, and fingerprints of any span in constant time.

Used inside Arrow tasks. A fingerprint of bytes s..e is a polynomial in an odd base over 2^64 with a random value for each
byte, read off running sums, then mixed; `seed` gives independent ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once in a task; one longer text is handled alone.
SLICE_BYTES = 1 << 20

_ALL = np.arange(256)
_DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
_LOWER = (_ALL >= 0x61) & (_ALL <= 0x7A)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, over bytes of lower-cased UTF-8.
ALNUM = _DIGIT | _LOWER | (_ALL >= 0x80)
#: `[^\x20\x09-\x0D]`
NOT_BLANK = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
_LOWERED = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWERED[buf]


def mix(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most `limit` bytes together, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


@lru_cache(maxsize=8)
def _table(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(0x5EED + seed)
    values = rng.integers(0, 2**64, 256, dtype=U64)
    base = int(rng.integers(0, 2**63, dtype=U64)) * 8 + 5 & (2**64 - 1)
    return values, base, pow(base, -1, 2**64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, n: int, inverse: bool) -> np.ndarray:
    """base^0 .. base^n (or of the inverse) modulo 2^64."""
    got = _POWERS.get((seed, inverse))
    if got is None or len(got) <= n:
        base = _table(seed)[2 if inverse else 1]
        size = max(n + 1, SLICE_BYTES + 1)
        got = np.empty(size, U64)
        got[0] = 1
        done = 1
        while done < size:  # doubles what is known
            step = min(done, size - done)
            got[done : done + step] = got[:step] * U64(pow(base, done, 2**64))
            done += step
        if size <= 4 * SLICE_BYTES:
            _POWERS[seed, inverse] = got
    return got


class Sums:
    """Running sums over `buf`, from which spans get their fingerprints."""

    def __init__(self, buf: np.ndarray, seed: int = 0):
        self.seed, self.n = seed, len(buf)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_table(seed)[0][buf] * _powers(seed, len(buf), False)[: len(buf)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _powers(self.seed, self.n, True)[start]
        return mix(h + (np.asarray(end) - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def word_spans(buf: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of `letters` bytes; a run never crosses rows."""
    inside = letters[buf]
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens = inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))
    closes = inside & (first[1:] | ~np.concatenate((inside[1:], [False]))) if n else inside
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's entries begin in an array sorted by row; one more entry than rows."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
