"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: A-Z to lower case, the five control spaces to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 20
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        _tables[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def head_hashes(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length a hash of the first bytes of each word of data, parted by spaces; 0: of the whole word."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = a != 32
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return [np.empty(0, dtype=np.uint64)] * len(lengths)
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(a)), out=sums[1:])
    back = _powers(_INVERSE, len(a))[start]
    return [mix((sums[np.minimum(end, start + n) if n else end] - sums[start]) * back + np.uint64(n)) for n in lengths]


def _hash_block(data: bytes) -> np.ndarray:
    return head_hashes(data, (0,))[0]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the text, in order; long texts go through in blocks cut at spaces."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    if len(data) <= _CHUNK:
        return _hash_block(data)
    parts, at = [], 0
    while at < len(data):
        to = data.find(b" ", at + _CHUNK)
        to = len(data) if to < 0 else to
        parts.append(_hash_block(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; fewer words: the whole sequence as one; none: empty."""
    h = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(h):
        return h
    n = min(k, len(h))
    s = h[: len(h) - n + 1] + np.uint64(n)
    for j in range(1, n):
        s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - n + 1 + j])
    return np.unique(s)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
