"""Numpy hashing of byte strings: a polynomial prefix hash gives the hash of any slice in two look-ups.

With odd base R, P[i] = sum of code[b[j]] * R^j over j < i (mod 2^64), the hash of b[i:j] is (P[j] - P[i]) * R^-i,
mixed. It depends on the bytes alone, so equal slices hash alike wherever they stand."""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_state: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); returns a new array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i for i <= n, kept between calls (they grow to the longest text of the task)."""
    if "pow" not in _state or len(_state["pow"]) <= n:
        size = max(1 << 16, 2 * n)
        for name, base in (("pow", _R), ("inv", _R_INV)):
            steps = np.full(size + 1, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _state[name] = np.multiply.accumulate(steps)
    return _state["pow"], _state["inv"]


def prefix(b: np.ndarray) -> np.ndarray:
    """P of a uint8 array, one longer than it."""
    p = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(CODES[b] * _powers(len(b))[0][:len(b)], out=p[1:])
    return p


def slices(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end) of the bytes behind prefix `p`."""
    return mix((p[end] - p[start]) * _powers(len(p))[1][start])


def grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte slices."""
    if len(b) < k:
        return np.zeros(0, dtype=np.uint64)
    p = prefix(b)
    return mix((p[k:] - p[:-k]) * _powers(len(b))[1][:len(b) - k + 1])


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words of single-space-joined bytes; empty arrays without words."""
    b = np.frombuffer(joined, dtype=np.uint8)
    if not len(b):
        return b, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gaps = np.flatnonzero(b == 32)
    return b, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))


def word_hashes(joined: bytes) -> np.ndarray:
    b, start, end = word_bounds(joined)
    return slices(prefix(b), start, end) if len(start) else np.zeros(0, dtype=np.uint64)


def shingle_hashes(joined: bytes, k: int) -> np.ndarray:
    """Hashes of all runs of k words; fewer words, but not none, are one run."""
    b, start, end = word_bounds(joined)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    if len(start) < k:
        return slices(prefix(b), start[:1], end[-1:])
    return slices(prefix(b), start[:len(start) - k + 1], end[k - 1:])


def space_words(text: str | None) -> bytes:
    """Lower-cased (A-Z) words between ASCII white space, joined by single spaces: bytes methods know ASCII only,
    which is the contract's class."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


_ALNUM = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32
               for i in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words of 0-9, a-z and non-ASCII characters after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []
