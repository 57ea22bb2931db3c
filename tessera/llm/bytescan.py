"""Byte-level text kernels in numpy: one Arrow batch is one flat byte array.

Work runs in pieces of a few MB so that memory follows the piece size; a
longer single text is one piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20

#: words of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (any byte of a
#: non-ASCII character is a word byte)
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: words between white space: [^\x20\x09-\x0D]+
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)      # odd, so they have inverses modulo 2**64
_pow: dict = {}


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse (kept for the next call)."""
    if which not in _pow or len(_pow[which][0]) < n:
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            a = np.full(max(n, 1 << 16), np.uint64(base))
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _pow[which] = both
    return _pow[which][0][:n], _pow[which][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the entropy of a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; runs end at row borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span (starts ascending)."""
    return spans_hashes(data, starts, [ends])[0]


def spans_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], which: int = 0) -> list[np.ndarray]:
    """Hashes of several spans from each start, by one of two independent
    hash functions. Prefix sums are kept for a few MB (or one span) at a time."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + PIECE, "left")))
        hi = max(int(e[i:j].max()) for e in ends)
        p, inv = _powers(hi - lo + 1, which)
        h = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[which][data[lo:hi]] * p[:-1], out=h[1:])
        s = starts[i:j] - lo
        head, back = h[s], inv[s]
        for o, end in zip(out, ends):
            e = end[i:j] - lo
            o[i:j] = (h[e] - head) * back + (e - s).astype(np.uint64)
        i = j
    return [mix(o) for o in out]


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-cased word."""
    low = LOWER[data]
    s, e = runs(ALNUM[low], off)
    return span_hashes(low, s, e), rows_of(s, off)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + counts[i] - 1, all in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)
