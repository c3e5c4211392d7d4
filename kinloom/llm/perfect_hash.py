"""A minimal perfect hash for one bucket of keys, by cascading bit arrays.

Each level hashes the keys that are left to a bit array; a key alone on its bit stays there, the others
go to the next level. A key's slot is the number of set bits before its own, over all levels. A stored
fingerprint tells keys of the index from others.
"""

from __future__ import annotations

import numpy as np

#: Bits per key that is left.
GAMMA = 2.0
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit hash (the splitmix64 finaliser) of x under a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """keys: distinct 64-bit hashes. Returns the levels' sizes in bits and the bits of all levels."""
    sizes, levels, left, level = [], [], keys.astype(np.uint64), 0
    while len(left):
        m = max(8, int(GAMMA * len(left)) + 7 & ~7)
        at = (mixed(left, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        levels.append(alone)
        left, level = left[~alone[at]], level + 1
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, np.packbits(bits).tobytes()


def slots(keys: np.ndarray, sizes: list[int], packed: bytes) -> np.ndarray:
    """The slot of each key, or -1 where no level holds it (only for keys outside the index)."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    rank = np.cumsum(bits, dtype=np.int64) - bits
    out, open_, base = np.full(len(keys), -1, np.int64), np.ones(len(keys), bool), 0
    for level, m in enumerate(sizes):
        at = base + (mixed(keys, level) % np.uint64(m)).astype(np.int64)
        hit = open_ & (bits[at] == 1)
        out[hit] = rank[at[hit]]
        open_ &= ~hit
        base += m
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)
