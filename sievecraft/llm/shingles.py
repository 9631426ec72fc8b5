"""Sets of hashed shingles and their MinHash signatures, computed on arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that all bits depend on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER to the powers 0 .. size, and their inverses modulo 2**64."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    up, down = np.full(size + 1, MULTIPLIER), np.full(size + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes without white space, in order."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    edges = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    size = 1 << max(12, len(data).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(items: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` items; of the whole sequence if it is shorter; none if it is empty."""
    if not len(items):
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(items))
    total = np.zeros(len(items) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * MULTIPLIER + items[k : k + len(total)]
    return mixed(total + np.uint64(width))


def word_shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text's words: A-Z lower-cased, split at ASCII white space."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(word_hashes(text.encode("utf-8", "surrogatepass").lower()), width))


def character_shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text's code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.unique(windows(mixed(points.astype(np.uint64) + np.uint64(1)), width))


@cache
def _permutations(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    flips = random.integers(0, 1 << 32, slots, dtype=np.uint64).astype(np.uint32)
    factors = random.integers(0, 1 << 31, slots, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return flips, factors


def signature(shingles: np.ndarray, slots: int, seed: int = 11) -> np.ndarray:
    """The b-bit MinHash signature (b = 16): the low bits of the smallest hash under each of ``slots`` permutations."""
    flips, factors = _permutations(slots, seed)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(slots, dtype=np.uint16)
    for k in range(slots):
        out[k] = ((low ^ flips[k]) * factors[k]).min() & np.uint32(0xFFFF)
    return out
