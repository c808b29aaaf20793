"""Label shuffles that need no shuffle: a keyed bijection of the row numbers.

Shuffling the labels of n rows means giving row i the label at place pi(i) of the
label list. With pi a keyed Feistel network on 0..n-1, both are functions of i and
of the label counts: every shuffle keeps the counts exactly, any task can compute
it, and a recomputed task gets the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Odd multipliers of the mix.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
ROUNDS = 6
_LOW = np.uint64(0xFFFFFFFF)


def mix(v: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """A 32-bit mix of ``v`` under a key. Products stay below 2**64, so that any engine with
    unsigned 64-bit numbers can state it."""
    a, b, c = (np.uint64(m) for m in MULTIPLIERS)
    z = (np.asarray(v, np.uint64) * a + np.asarray(key, np.uint64)) & _LOW
    z = ((z ^ (z >> np.uint64(15))) * b) & _LOW
    z = ((z ^ (z >> np.uint64(13))) * c) & _LOW
    return z ^ (z >> np.uint64(16))


def permute(index: np.ndarray, n: int, seed: int, draw: int) -> np.ndarray:
    """Image of each index under shuffle number ``draw`` of 0..n-1 (n up to 2**64)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = mix(np.arange(ROUNDS) + draw * ROUNDS, int(mix(seed, 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for key in keys:
            left, right = right, left ^ (mix(right, key) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    # Values outside the domain walk on until they fall inside it.
    away = out >= np.uint64(n)
    while away.any():
        out[away] = once(out[away])
        away = out >= np.uint64(n)
    return out.astype(np.int64)


@dataclass(frozen=True)
class LabelShuffle:
    """Shuffled labels from the label counts: ``bounds[s]`` rows have a label <= s."""

    n: int
    bounds: tuple[int, ...]
    seed: int = 0

    @classmethod
    def from_counts(cls, counts: list[int], seed: int = 0) -> "LabelShuffle":
        edges = np.cumsum(counts)
        return cls(int(edges[-1]), tuple(int(e) for e in edges), seed)

    def places(self, index: np.ndarray, draw: int) -> np.ndarray:
        """Places in the label list; the same for all label counts of ``n`` rows."""
        return permute(np.asarray(index), self.n, self.seed, draw)

    def at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.asarray(self.bounds), places, side="right")

    def labels(self, index: np.ndarray, draw: int) -> np.ndarray:
        return self.at(self.places(index, draw))
