"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums, so that one pass
over a block of texts hashes all its words; a shingle's hash combines those of its words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words: white space; or, after lower-casing, all of ASCII but digits and letters.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest block so far needs."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            n = max(n + 1, 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def word_bounds(block: np.ndarray, offsets: np.ndarray, between: np.ndarray):
    """Starts and ends of the words of a block, and the number of words before each text's end."""
    inside = ~between[block]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def range_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges of a block, each by its bytes alone."""
    up, down = _Powers.upto(len(block))
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_BYTE[block] * up[: len(block)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANKS):
    """64-bit hashes of the lower-cased words of all texts, and where each text's words begin.

    Text i has the words bounds[i]:bounds[i + 1].
    """
    block = LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends, bounds = word_bounds(block, offsets - offsets[0], between)
    return range_hashes(block, starts, ends), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int):
    """Hashes of all runs of ``width`` words within a text, and where each text's runs begin.

    A text of fewer words has its whole sequence as its only run; one without words has none.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    place = np.repeat(bounds[:-1] - out_bounds[:-1], runs) + np.arange(out_bounds[-1])
    size = np.repeat(np.minimum(counts, width), runs)
    total = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    short = size < width
    any_short = short.any()
    for j in range(width):
        term = padded[place + j] * _PLACE[j]
        if any_short:
            term[j >= size] = 0
        total += term
    return mix(total), out_bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, between: np.ndarray = BLANKS):
    """For each text, the sorted distinct hashes of its shingles."""
    hashes, bounds = shingle_hashes(*word_hashes(data, offsets, between), width)
    for i in range(len(bounds) - 1):
        own = np.sort(hashes[bounds[i] : bounds[i + 1]])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
