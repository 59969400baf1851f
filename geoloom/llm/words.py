"""Words of texts and their 64-bit hashes, for whole Arrow batches at a time.

A word is a run of bytes other than space and \\x09-\\x0D. A hash is a polynomial over a table of random numbers,
so prefix sums give it for every word of a batch at once; only numpy runs, no loop over words."""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_RUN, _PIECE = 1 << 20, 1 << 16  # bytes summed up at once at most, and mostly: a piece's sums stay in the cache
_TABLE = np.random.default_rng(7_301_2024).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        steps = np.full(_RUN, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of raw; spans in ascending order. Equal spans have equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + min(_PIECE, _RUN), "right"))
        to = to if to > at else int(np.searchsorted(ends, starts[at] + _RUN, "right"))
        if to <= at:  # a word longer than a run
            digest = hashlib.blake2b(raw[starts[at] : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = np.frombuffer(digest, np.uint64)[0]
            at += 1
            continue
        low, high = starts[at], ends[to - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_TABLE[raw[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, starts, ends): words offsets[i]:offsets[i + 1] are those of text i; starts and ends are bytes of raw."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return np.zeros(len(bounds), np.int64), empty, empty
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = bounds[1:][bounds[1:] > 0] - 1
    last[edges] = word[edges]
    starts = np.flatnonzero(first)
    return np.searchsorted(starts, bounds), starts, np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the words of the texts. lower: A-Z count as a-z."""
    offsets, starts, ends = spans(raw, bounds)
    return offsets, hash_spans(LOWER[raw] if lower else raw, starts, ends)


def shingles(offsets: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of all runs of `size` words; a text with fewer words, but any, has one run of all its words."""
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(offsets[:-1] - out_offsets[:-1], n) + np.arange(out_offsets[-1])
    base = np.uint64(0xD6E8FEB86659FD93)
    runs = np.full(max(0, len(hashes) - size + 1), size, np.uint64)  # those over a text's end aren't taken
    for k in range(size):
        runs *= base
        runs += hashes[k : len(runs) + k]
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = runs[np.minimum(at, len(runs) - 1)] if len(runs) else np.zeros(len(at), np.uint64)
    first = np.full(len(short), size, np.uint64)
    for k in range(size if len(short) else 0):
        inside = k < counts[short]
        part = hashes[np.minimum(offsets[:-1][short] + k, len(hashes) - 1)]
        first = first * base + np.where(inside, part, np.uint64(k + 1))
    out[out_offsets[:-1][short]] = first
    return out_offsets, mix(out)
