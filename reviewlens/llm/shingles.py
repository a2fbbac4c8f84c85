"""Word shingles of texts as 64-bit hashes, whole arrays at a time.

A word is hashed as a polynomial of its bytes, read off running sums over the buffer, and a
shingle as a polynomial of its words' hashes; both are mixed. Two of n different shingles get
one hash with odds of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = 0xD1342543DE82EF95
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        ones = np.ones(max(n, _PIECE + 1), np.uint64)
        _powers[:] = []
        for r in (_R, _R_INVERSE):
            table = ones * r
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of ``text``, which has A-Z lowered, in order."""
    if len(text) <= _PIECE:
        return _piece_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        # a piece ends at a blank; a longer word makes a longer piece
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(_piece_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def _piece_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start])


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole when it is shorter."""
    words = word_hashes((text or b"").lower())
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(_A) + words[j : n - k + 1 + j]
    return np.unique(_mix(total + np.uint64(k)))
