"""Words and word shingles of many texts at once, as 64-bit hashes over the flat bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

from helixmill.llm._base import flat, mix, slices

WIDTH = 5
SLICE = 1 << 21
#: Odd, so it has an inverse modulo 2 ** 64; powers of both are kept per slice.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = np.uint64(0x100000001B3)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_noise = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        full = np.ones(max(n, 1024), np.uint64)
        full[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(full, dtype=np.uint64)
    return _powers[base]


def prefix_hashes(data: np.ndarray, noise: np.ndarray = _noise, base: int = _BASE) -> np.ndarray:
    """Sums up to each position; span(p, s, e) turns two of them into the hash of what is between."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(noise[data] * powers(base, len(data))[: len(data)], out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = _BASE_INVERSE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start])


def ranges(at: np.ndarray):
    """Ranges of texts of some 2 MB and at most 1,024 texts."""
    for i, j in slices(at, SLICE):
        for k in range(i, j, 1024):
            yield k, min(j, k + 1024)


def sets_of(column):
    """Yields (i, j, row, hash): for the texts i to j, their distinct shingle hashes, grouped by row (0 is text i).

    Words are runs of other than white space, A-Z in lower case; a text of 1 to 4 words is one shingle."""
    data, at = flat(column)
    for i, j in ranges(at):
        yield i, j, *_sets(data, at, i, j)


def _sets(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    row, _, shingle = shingles(data, at, i, j)
    # ten bits of row above 54 bits of hash sort both at once; the ranges hold 1,024 texts at most
    key = np.unique((row.astype(np.uint64) << np.uint64(54)) | (shingle >> np.uint64(10)))
    return (key >> np.uint64(54)).astype(np.int64), mix((key & np.uint64((1 << 54) - 1)) + np.uint64(1))


def words(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row (0 is text i), start, end and hash of each word of texts i to j; positions are relative to text i."""
    part, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
    inside = ~_space[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = ends[(ends > 0) & (ends < len(part))]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = _lower[part]
    return np.searchsorted(ends, start, "right") - 1, start, end, span(prefix_hashes(low), start, end)


def shingles(data: np.ndarray, at: np.ndarray, i: int, j: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index of the first word within words(), and hash of each shingle."""
    row, _, _, word = words(data, at, i, j)
    n = len(row)
    if not n:
        return row, row, word
    here = np.arange(n)
    left = np.searchsorted(row, row, "right") - here  # words from here to the text's end
    new = np.ones(n, bool)
    new[1:] = row[1:] != row[:-1]
    begins = np.flatnonzero((left >= width) | new)
    size = np.minimum(left[begins], width)
    out = np.zeros(len(begins), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            one = np.where(size > k, word[np.minimum(begins + k, n - 1)], np.uint64(k + 1))
            out = mix(out * _PRIME + one)
    return row[begins], begins, out
