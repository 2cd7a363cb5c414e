"""Minimal perfect hash over a shard of 64-bit keys, as one block of bytes.

Level by level, each key that alone falls on a bit of the level's bit array keeps it; the
others go on to the next level. A key's number is the count of set bits before its own.
About three bits a key, built and read by numpy over whole arrays.
"""

from __future__ import annotations

import numpy as np

from platewise.llm.rawtext import U, mix

#: Bits per key still without a place on a level.
SPREAD = 2.0
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U(size)).astype(np.int64)


class PerfectHash:
    """`levels` are sizes in bits, each a multiple of 64; `bits` holds them one after another."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.starts = np.cumsum(levels) - levels
        ones = _BITS[bits].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        levels, parts = [], []
        rest = keys
        while len(rest):
            size = -(-int(len(rest) * SPREAD) // 64) * 64
            slots = _slots(rest, len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(size)
            parts.append(np.packbits(alone))
            rest = rest[~alone[slots]]
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return cls(np.array(levels, np.int64), bits)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """A key's number; of other values some number or -1."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.levels)):
            if not len(rest):
                break
            at = start + _slots(keys[rest], level, int(size))
            hit = self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
            at, done = at[hit], rest[hit]
            word = at >> 6
            inside = self.bits.reshape(-1, 8)[word].copy()
            # blank the bits from the key's own on
            place = (at & 63)[:, None] - 8 * np.arange(8)
            inside &= (0xFF00 >> np.clip(place, 0, 8) & 0xFF).astype(np.uint8)
            found[done] = self.before[word] + _BITS[inside].sum(axis=1, dtype=np.int64)
            rest = rest[~hit]
        return found


def shard_block(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> bytes:
    """Hash, fingerprint array and count array of distinct keys."""
    table = PerfectHash.of(keys)
    at = table.numbers(keys)
    by_print, by_count = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
    by_print[at], by_count[at] = prints, counts
    head = np.array([len(keys), len(table.levels), len(table.bits)], np.int64)
    return b"".join(x.tobytes() for x in (head, table.levels, by_print, by_count, table.bits))


class Shard:
    """A block read back without copying."""

    def __init__(self, block: bytes):
        size, levels, bits = np.frombuffer(block, np.int64, 3)
        at = 24
        read = lambda kind, n: np.frombuffer(block, kind, n, at)
        sizes = read(np.int64, levels)
        at += 8 * levels
        self.prints = read(np.uint64, size)
        at += 8 * size
        self.counts = read(np.int64, size)
        at += 8 * size
        self.table = PerfectHash(sizes, read(np.uint8, bits))

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where the fingerprint tells that it is none of the shard."""
        number = self.table.numbers(keys)
        ok = number >= 0
        ok[ok] = self.prints[number[ok]] == prints[ok]
        out = np.zeros(len(keys), np.int64)
        out[ok] = self.counts[number[ok]]
        return out
