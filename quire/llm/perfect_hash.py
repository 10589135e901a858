"""Minimal perfect hashing of 64-bit keys, in shards.

The keys of a shard get the numbers 0 to n - 1 by levels: on each level a key
hashes to one of twice as many bits as keys are left; keys alone on their bit are
placed, the others go to the next level.  A key's number is the rank of its bit.
The function knows any key a number, so callers keep the keys and compare.
"""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLDEN = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.view(np.uint64) ^ np.uint64((seed + 1) * _GOLDEN & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def _place(keys: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """A bit below `bits` for each key."""
    return ((mixed(keys, level) >> np.uint64(32)) * np.asarray(bits, np.uint64)) >> np.uint64(32)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits as 64-bit words, the keys in the order
    of their numbers) for distinct int64 keys.  Levels start at whole words."""
    sizes, words, ordered, left = [], [], [], keys
    while len(left):
        bits = -(-2 * len(left) // 64) * 64
        place = _place(left, len(sizes), bits).astype(np.int64)
        alone = np.bincount(place, minlength=bits) == 1
        own = alone[place]
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        placed = left[own]
        ordered.append(placed[np.argsort(place[own])])
        sizes.append(bits)
        left = left[~own]
    none = np.empty(0, np.uint64)
    return sizes, np.concatenate(words or [none]), np.concatenate(ordered or [none.view(np.int64)])


class Shards:
    """The functions of several shards, numbered through: `number` gives keys of
    any of them a place in one dense vector."""

    def __init__(self, count: int, rows: list[tuple[int, list[int], bytes]]):
        """`count` shards in all; `rows`: (shard, bits of each level, words)."""
        self.count = count
        self.first = np.zeros(count, np.int64)  # of the shard's numbers
        levels = max([0, *(len(r[1]) for r in rows)])
        self.size = np.zeros((levels, count), np.uint64)
        self.word = np.zeros((levels, count), np.int64)
        parts, at = [], 0
        for shard, sizes, data in rows:
            part = np.frombuffer(data, np.uint64)
            parts.append(part)
            for level, bits in enumerate(sizes):
                self.size[level, shard], self.word[level, shard] = bits, at
                at += bits // 64
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        for shard, sizes, _ in rows:
            self.first[shard] = self.before[self.word[0, shard]] if sizes else 0
        self.n = int(self.before[-1])

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return shard_of(keys, self.count)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for keys that surely aren't known."""
        shard = self.shard(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.size)):
            size = self.size[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            place = _place(keys[left], level, size).astype(np.int64)
            word = self.word[level, shard[left]] + (place >> 6)
            bit = np.uint64(1) << (place & 63).astype(np.uint64)
            here = (self.words[word] & bit) != 0
            w = word[here]
            out[left[here]] = self.before[w] + np.bitwise_count(self.words[w] & (bit[here] - np.uint64(1)))
            left = left[~here]
        return out


def shard_of(keys: np.ndarray, count: int) -> np.ndarray:
    return (_place(keys, 1_000, count)).astype(np.int64)
