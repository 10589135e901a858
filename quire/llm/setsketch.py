"""Word-shingle sets and SetSketch registers (numpy, run inside Spark tasks).

A document's set holds 64-bit hashes of its distinct five-word shingles.  A
register is a truncated minimum on an exponential scale: every shingle gets an
exponential variate per register, the register keeps floor(1 - log_b(min)).
Registers of a union are the register-wise maximum of the parts, and the share
of equal registers follows the Jaccard similarity of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quire.llm.wordhash import word_hashes

SHINGLE_WORDS = 5
REGISTERS = 120  # 24 bands of 5 registers
BASE = 1.2  # spacing of the register scale
RATE = 20.0  # rate of the exponential variates
LIMIT = 254  # registers are truncated to 0 .. LIMIT + 1, one byte each

_M = np.uint64
_ODD = (np.random.default_rng(20250102).integers(0, 2**31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_WORD_FACTORS = [_M(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SET_SALT = _M(0x8EBC6AF09C88C6E3)
_CHUNK = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> _M(33))
    x = x * _M(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _M(33))
    x = x * _M(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _M(33))


def _joined(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE_WORDS consecutive word hashes."""
    m = len(words) - SHINGLE_WORDS + 1
    acc = words[:m] * _WORD_FACTORS[0]
    for i in range(1, SHINGLE_WORDS):
        acc += words[i : i + m] * _WORD_FACTORS[i]
    return mix(acc)


def _few(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer than SHINGLE_WORDS words."""
    if not len(words):
        return words
    acc = np.array([len(words)], np.uint64) * _SET_SALT
    for i, h in enumerate(words):
        acc += np.array([h], np.uint64) * _WORD_FACTORS[i]
    return mix(acc)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, words split
    at ASCII white space.  Fewer than five words: the whole sequence is one
    shingle; null or no word: the empty set."""
    for words in word_hashes(texts):
        yield np.unique(_joined(words)) if len(words) >= SHINGLE_WORDS else _few(words)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify the set (order-free)."""
    a = int(mix(shingles ^ _SET_SALT).sum(dtype=np.uint64))
    b = int(mix(shingles + _WORD_FACTORS[1]).sum(dtype=np.uint64))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def registers(shingles: np.ndarray) -> bytes:
    """The REGISTERS bytes of a non-empty set."""
    low = (shingles & _M(0xFFFFFFFF)).astype(np.uint32)
    high = (shingles >> _M(32)).astype(np.uint32)
    half = REGISTERS // 2
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), _CHUNK):
        np.minimum(least[:half], (_ODD[:half, None] * low[None, i : i + _CHUNK]).min(axis=1), out=least[:half])
        np.minimum(least[half:], (_ODD[half:, None] * high[None, i : i + _CHUNK]).min(axis=1), out=least[half:])
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint8).tobytes()


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other by at least one step."""
    return -np.log1p(-x * (BASE - 1.0) / BASE) / np.log(BASE)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from the counts of larger,
    smaller and equal registers and the known set sizes (joint estimation).

    a, b: (pairs, REGISTERS) bytes; n_a, n_b: set sizes."""
    above = (a > b).sum(axis=1)[:, None]
    below = (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, steps)[None, :] * top
    p_above = np.clip(_p(np.maximum(u - v * grid, 0.0)), 1e-12, 1.0)
    p_below = np.clip(_p(np.maximum(v - u * grid, 0.0)), 1e-12, 1.0)
    p_equal = np.clip(1.0 - p_above - p_below, 1e-12, 1.0)
    score = above * np.log(p_above) + below * np.log(p_below) + equal * np.log(p_equal)
    return grid[np.arange(len(grid)), score.argmax(axis=1)]
