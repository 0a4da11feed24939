"""Hashes of words and shingles of many texts at once, on arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: The multipliers of the splitmix64 finaliser.
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: An odd base, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_alnum: np.ndarray | None = None
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64; kept for the next call."""
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 1 << 16), U(base))
        factors[0] = U(1)
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:n]


def alnum() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _alnum


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, a line feed after each text, and where each text starts."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.cumsum(sizes) - sizes


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of which ``span_hash`` makes the hash of any stretch of ``codes``."""
    spread = mix(codes.astype(U) + U(_BASE))
    sums = np.empty(len(codes) + 1, U)
    sums[0] = 0
    np.cumsum(spread * powers(_BASE, len(codes)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from start to end, the same wherever a stretch stands."""
    return mix((sums[end] - sums[start]) * powers(_BACK, len(sums))[start] + (end - start).astype(U))


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in order of the texts, and each text's number of them.

    Words are the maximal runs of letters and digits of the lower-cased text.
    """
    codes, starts = code_points([t.lower() for t in texts])
    inside = np.concatenate([[False], alnum()[codes], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    words = span_hash(prefix_sums(codes), first, last)
    per_text = np.diff(np.searchsorted(first, np.append(starts, len(codes))))
    if len(words) < n:
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    runs = words[: len(words) - n + 1] * U(1)
    for k in range(1, n):
        runs = mix(runs) + words[k : len(words) - n + 1 + k]
    owner = np.repeat(np.arange(len(texts)), per_text)
    whole = owner[: len(runs)] == owner[n - 1 :]
    return mix(runs[whole]), np.maximum(per_text - n + 1, 0)
