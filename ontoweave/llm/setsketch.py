"""SetSketch registers: exponentially spaced, truncated minima of a set's hashes.

Register i of a set is ``floor(1 - log_b(E_i))``, cut to 16 bits, where E_i is the smallest of
its elements' exponential draws with rate A. Sketches of a union are the larger registers
(mergeable), and registers of similar sets agree with a probability close to their Jaccard
similarity (locality-sensitive), so that bands of registers find candidates. Which of two
registers is larger, and how often, gives the similarity by maximum likelihood once both
set sizes are known.
"""

from __future__ import annotations

import numpy as np

REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, (1 << 16) - 1
#: Registers of a band. 32 bands of 4 miss a pair of similarity 0.75 once in 400,000.
ROWS = 4
BANDS = REGISTERS // ROWS
#: A pair stays a candidate unless the likelihood of every similarity allowed is below the
#: best one by more than this (as a logarithm): a true pair is lost once in 200,000.
MARGIN = 10.0

_seeds = np.random.default_rng(20240229)
XORS = _seeds.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
ODDS = _seeds.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
CHUNK = 1 << 16


def registers(minima: np.ndarray) -> np.ndarray:
    """Registers from the smallest 32-bit hash of each."""
    uniform = (minima.astype(np.float64) + 0.5) / float(1 << 32)
    spaced = np.floor(1.0 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(spaced, 0, TOP).astype(np.uint16)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each non-empty set of 64-bit hashes."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    start = 0
    while start < len(sets):
        stop, size = start + 1, len(sets[start])
        while stop < len(sets) and size + len(sets[stop]) <= CHUNK:
            size += len(sets[stop])
            stop += 1
        group = sets[start:stop]
        offsets = np.cumsum([0] + [len(s) for s in group[:-1]])
        whole = np.concatenate(group)
        halves = (whole >> np.uint64(32)).astype(np.uint32) ^ whole.astype(np.uint32)
        minima = np.empty((len(group), REGISTERS), np.uint32)
        for i in range(REGISTERS):
            hashed = (halves ^ XORS[i]) * ODDS[i]
            hashed ^= hashed >> np.uint32(15)
            minima[:, i] = np.minimum.reduceat(hashed * ODDS[i - 1], offsets)
        out[start:stop] = registers(minima)
        start = stop
    return out


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1.0) / BASE) / np.log(BASE)


def likely(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (rows) may have a similarity of at least ``least``, by joint likelihood."""
    n_left, n_right = n_left.astype(np.float64), n_right.astype(np.float64)
    possible = np.minimum(n_left, n_right) >= least * np.maximum(n_left, n_right)
    out = np.zeros(len(left), bool)
    at = np.flatnonzero(possible)
    if not len(at):
        return out
    above = (left[at] > right[at]).sum(1)[:, None]
    below = (left[at] < right[at]).sum(1)[:, None]
    same = left.shape[1] - above - below
    u = (n_left[at] / (n_left[at] + n_right[at]))[:, None]
    v = 1.0 - u
    top = np.minimum(u / v, v / u)
    grid = np.concatenate([top * np.linspace(0, 1, 81)[None, :-1], top - 1e-9, np.minimum(least, top)], axis=1)
    more, less = _share(np.maximum(u - v * grid, 1e-12)), _share(np.maximum(v - u * grid, 1e-12))
    value = above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))
    allowed = np.where(grid >= least - 1e-9, value, -np.inf).max(1)
    out[at] = allowed >= value.max(1) - MARGIN
    return out
