"""Hashed word shingles of whole texts, vectorised over bytes.

Words are runs of non-white-space ASCII-wise (\\x20, \\x09-\\x0D separate), A-Z lower-cased. A word's hash is
polynomial over its bytes, taken as a difference of prefix sums modulo 2**64; a shingle's mixes five of them.
"""

from __future__ import annotations

import numpy as np

from ledgerloom.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    found = _powers.get(str(base))
    if found is None or len(found) < n:
        size = 1 << max(16, (n - 1).bit_length())
        found = np.ones(1, np.uint64)
        while len(found) < size:
            found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
        if size <= 1 << 22:
            _powers[str(base)] = found
    return found[:n]


def forget() -> None:
    _powers.clear()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of some bytes."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[_FOLD[raw]] * _power(_BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64)), starts, ends


def shingles_of(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending; the whole sequence as one when there are fewer words than ``size``."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    count = n - width + 1
    out = np.full(count, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix64(out + words[k : k + count] * np.uint64(_BASE))
    return np.unique(out)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts one after another, and where each text's begin and end: n + 1 offsets."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    hashes, starts, _ = word_hashes(b"\n".join(raws))
    return hashes, np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(hashes))


def shingle_sets(texts: list[str], size: int = 5):
    """The shingle set of each text."""
    words, at = words_of(texts)
    n = len(words) - size + 1
    every = np.full(max(n, 0), np.uint64(size), np.uint64)
    for k in range(size if n > 0 else 0):
        every = mix64(every + words[k : k + n] * np.uint64(_BASE))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(every[a : b - size + 1]) if b - a >= size else shingles_of(words[a:b], size)
