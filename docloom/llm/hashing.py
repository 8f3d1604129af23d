"""64-bit hashes of tokens, spans and n-grams over numpy arrays, all of it vectorised."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_byte_tokens = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def byte_tokens(raw: np.ndarray) -> np.ndarray:
    return _byte_tokens[raw]


def span_hashes(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span ``tokens[start:end]``: differences of prefix sums of a polynomial."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _powers_of(_ODD, len(tokens)), out=sums[1:])
    back = _powers_of(_INVERSE, len(tokens) + 1)
    h = (sums[ends] - sums[starts]) * back[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


#: A Mersenne prime, and a number whose powers stand for places.
_PRIME = np.uint64(2**61 - 1)
_BASE = 0x1B873593CC9E2D51 % (2**61 - 1)
_prime_powers: dict[int, np.ndarray] = {}
#: Tokens whose products are made at a time.
_CHUNK = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - _PRIME)  # below the prime the difference wraps around


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 31 bits."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    high, rest = middle >> np.uint64(30), middle & np.uint64(2**30 - 1)
    return _reduced(np.uint64(2) * ah * bh + high + (rest << half) + al * bl)


def _prime_powers_of(base: int, n: int) -> np.ndarray:
    have = _prime_powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**61 - 1))
        have = np.concatenate([have, _times(have, step)])
    _prime_powers[base] = have
    return have[:n]


def prime_hashes(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Like ``span_hashes``, modulo a prime: no family of texts cancels out, however regular."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    powers = _prime_powers_of(_BASE, len(tokens))
    highs, lows = np.zeros(len(tokens) + 1, np.uint64), np.zeros(len(tokens) + 1, np.uint64)
    for a in range(0, len(tokens), _CHUNK):  # products of a few tokens stay in the cache
        values = _times(_reduced(tokens[a : a + _CHUNK]), powers[a : a + _CHUNK])
        highs[a + 1 : a + 1 + _CHUNK] = values >> half
        lows[a + 1 : a + 1 + _CHUNK] = values & low
    np.cumsum(highs, out=highs)
    np.cumsum(lows, out=lows)
    high, rest = highs[ends] - highs[starts], lows[ends] - lows[starts]
    sums = _reduced((high >> np.uint64(30)) + ((high & np.uint64(2**30 - 1)) << half) + _reduced(rest))
    back = _prime_powers_of(pow(_BASE, -1, 2**61 - 1), len(tokens) + 1)[starts]
    return mix(_times(sums, back) ^ mix((ends - starts).astype(np.uint64)))


def grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive tokens; empty below ``n`` tokens."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    h, width, step = None, 0, tokens
    size, factor = 1, np.uint64(0xD6E8FEB86659FD93)
    double = 0xC2B2AE3D27D4EB4F
    left = n
    while left:
        if left & 1:  # append a block of ``size`` tokens
            h = step.copy() if h is None else h[: len(tokens) - width - size + 1] * factor + step[width : len(tokens) - size + 1]
            width += size
        left >>= 1
        if left:
            step = step[:-size] * np.uint64(double) + step[size:]
            size, double = size * 2, (double * double + 2) % 2**64
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, values.dtype)
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values
