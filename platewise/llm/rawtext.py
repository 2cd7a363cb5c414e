"""Texts of an Arrow batch as one numpy byte buffer, with words, lines and rolling hashes.

A null text is an empty one. All functions work on the UTF-8 bytes, so nothing is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is a piece of its own.
PIECE = 2 << 20
#: The same where texts are hashed: hashes and sorted keys take some hundred bytes for each byte of text.
HASHED = 1 << 18

# --- fixed values -----------------------------------------------------------
# White space between words: blank, tab, LF, VT, FF, CR.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# ----------------------------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = spans(batch.column(column))
        start = 0
        while start < batch.num_rows:
            first = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, first + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each text in `joined(texts)`."""
    lengths = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
    offsets = offsets - offsets[0]
    return offsets[:-1], offsets[1:]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte buffer, and each one's start and end there."""
    filled = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return data, offsets[:-1], offsets[1:]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    values = values ^ (values >> U(32))
    values = values * U(0xD6E8FEB86659FD93)
    values = values ^ (values >> U(32))
    values = values * U(0xD6E8FEB86659FD93)
    return values ^ (values >> U(32))


_powers: dict[str, np.ndarray] = {}


def _room(size: int) -> int:
    """Powers that are made where `size` are asked for, so that few requests need more."""
    return 1 + HASHED * max(1, -(-(size - 1) // HASHED))


def _power(name: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        have = np.full(_room(size), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= PIECE + 1:
            _powers[name] = have
    return have[:size]


_PRIME = U((1 << 31) - 1)
_SMALL_BASE = 1_357_924_681
_SMALL_VALUES = np.random.default_rng(20251117).integers(1, int(_PRIME), 256, dtype=np.uint64)


def _reduced(values: np.ndarray) -> np.ndarray:
    """Values below 2**63 modulo the prime 2**31 - 1."""
    values = (values & _PRIME) + (values >> U(31))
    values = (values & _PRIME) + (values >> U(31))
    return np.where(values >= _PRIME, values - _PRIME, values)


def _small_power(name: str, base: int, size: int) -> np.ndarray:
    """Powers of a base modulo the prime, by doubling."""
    have = _powers.get(name)
    if have is None or len(have) < size:
        wanted = _room(size)
        have = np.ones(1, np.uint32)
        while len(have) < wanted:
            more = _reduced(have[: wanted - len(have)] * U(pow(base, len(have), int(_PRIME))))
            have = np.concatenate([have, more.astype(np.uint32)])
        if size <= PIECE + 1:
            _powers[name] = have
    return have[:size]


#: Bytes that are hashed at once.
BLOCK = 1 << 17


class Prefixes:
    """Polynomial hashes of every part of a byte buffer, in constant time each.

    Two in one: modulo 2**64, which spreads best but for which some unlike strings are alike
    under any base (those built like the Thue-Morse sequence), and modulo the prime 2**31 - 1,
    which has no such strings.
    """

    def __init__(self, data: np.ndarray):
        self.sums, self.small = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint32)
        self.down = _power("down", _BASE_INVERSE, len(data) + 1)
        self.small_down = _small_power("small down", pow(_SMALL_BASE, -1, int(_PRIME)), len(data) + 1)
        up, small_up = _power("up", _BASE, len(data)), _small_power("small up", _SMALL_BASE, len(data))
        for at in range(0, len(data), BLOCK):
            part, here = data[at : at + BLOCK], slice(at, at + BLOCK)
            after = slice(at + 1, at + 1 + len(part))
            np.cumsum(_BYTE_VALUES[part] * up[here], out=self.sums[after])
            self.sums[after] += self.sums[at]
            # a block's sum of values below 2**31 is far below 2**63
            small = np.cumsum(_reduced(_SMALL_VALUES[part] * small_up[here])) + U(self.small[at])
            self.small[after] = _reduced(small)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end); equal parts have equal values wherever they stand."""
        small = self.small[ends].astype(np.uint64) + (_PRIME - self.small[starts])
        small = _reduced(_reduced(small) * self.small_down[starts])
        return (self.sums[ends] - self.sums[starts]) * self.down[starts] + mix(small)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; no word crosses texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data]
    change = inside[1:] != inside[:-1]
    begin = np.zeros(len(data), bool)
    if len(data):
        begin[0] = inside[0]
        begin[1:] = change[:-1] & inside[1:-1]
    heads = starts[(starts < ends)]
    begin[heads] = inside[heads]
    first = np.flatnonzero(begin)
    finish = np.zeros(len(data) + 1, bool)
    finish[1:] = change & inside[:-1]
    tails = ends[(starts < ends)]
    finish[tails] = inside[tails - 1]
    last = np.flatnonzero(finish)
    return first, last, np.searchsorted(ends, first, "right")


def per_text(numbers: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many entries, or which sum of weights, each text has."""
    if weights is None:
        return np.bincount(numbers, minlength=count).astype(np.int64)
    return np.bincount(numbers, weights=weights, minlength=count).astype(np.int64)


def lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (before the line break) and text number of each line; an empty text has one."""
    breaks = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate([starts, breaks + 1]), kind="stable")
    last = np.sort(np.concatenate([ends, breaks]), kind="stable")
    # both lists are in text order: each text has one line more than it has breaks
    count = 1 + per_text(np.searchsorted(ends, breaks, "right"), len(starts))
    return first, last, np.repeat(np.arange(len(starts)), count)
