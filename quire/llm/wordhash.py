"""64-bit hashes of the white-space separated words of many texts at once.

A word's hash is a polynomial over per-byte random values modulo 2^64.  All
words of a block come from one cumulative sum, so there is no Python work per
word; a block is at most BLOCK bytes, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20

_rng = np.random.default_rng(7_411_853)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_UP = _powers(_FACTOR)
_DOWN = _powers(pow(_FACTOR, -1, 1 << 64))


def _pieces(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every run of non-space bytes in a block."""
    data = np.frombuffer(block, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * _DOWN[starts]


def _long(data: bytes) -> np.ndarray:
    """Word hashes of one text of any length, block by block."""
    done, open_hash, open_len = [], 0, 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        starts, ends, hashes = _pieces(block)
        if open_len and (not len(starts) or starts[0]):  # the open word ended with the last block
            done.append(np.array([open_hash], np.uint64))
            open_len = 0
        if open_len:  # the first piece goes on with the open word
            open_hash = (open_hash + int(hashes[0]) * pow(_FACTOR, open_len, 1 << 64)) & _MASK
            open_len += int(ends[0])
            if ends[0] < len(block):
                done.append(np.array([open_hash], np.uint64))
                open_len = 0
            starts, ends, hashes = starts[1:], ends[1:], hashes[1:]
        if len(ends) and ends[-1] == len(block):
            open_hash, open_len = int(hashes[-1]), int(ends[-1] - starts[-1])
            hashes = hashes[:-1]
        done.append(hashes)
    if open_len:
        done.append(np.array([open_hash], np.uint64))
    return np.concatenate(done) if done else np.empty(0, np.uint64)


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text in order (A-Z lower-cased; null: none)."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if group and size + len(data) + 1 > BLOCK:
            yield from _together(group)
            group, size = [], 0
        if len(data) + 1 > BLOCK:
            yield _long(data)
        else:
            group.append(data)
            size += len(data) + 1
    yield from _together(group)


def _together(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    starts, _, hashes = _pieces(b" ".join(group))
    bounds = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group]))
    first = 0
    for last in bounds:
        yield hashes[first:last]
        first = last
