"""Vectorised 64-bit hashes of words and of windows of words or characters, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = _U(int(_RNG.integers(2**62, 2**63)) | 1)
_STEP = _RNG.integers(2**62, 2**63, 64, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are hashed in pieces of about this many bytes, cut at white space, so that memory stays bounded.
PIECE = 1 << 21

_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse modulo 2^64, at least."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 1 << 16)
        inv = _U(pow(int(_BASE), -1, 2**64))
        _power = np.concatenate(([_U(1)], np.cumprod(np.full(size, _BASE, np.uint64))))
        _inverse = np.concatenate(([_U(1)], np.cumprod(np.full(size, inv, np.uint64))))
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), end - start


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte length of each run of bytes other than space and \\t to \\r."""
    if len(data) <= PIECE:
        return _piece_words(data)
    got, at = [], 0
    while at < len(data):
        cut = at + PIECE
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        got.append(_piece_words(data[at:cut]))
        at = cut
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements."""
    n = len(h) - k + 1
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def shingle_set(text: str | None, k: int, with_length: bool = False):
    """Sorted distinct hashes of the k-word windows of the lower-cased (A-Z) text; of fewer words, the whole sequence.

    With ``with_length`` also the byte length of one window of each hash.
    """
    h, size = words((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return (h, size) if with_length else h
    if len(h) < k:
        whole = mix(h.astype(np.uint64) * _STEP[: len(h)] + _U(len(h)))
        one = mix(np.array([whole.sum(dtype=np.uint64)], np.uint64))
        return (one, np.array([size.sum()])) if with_length else one
    w = windows(h, k)
    if not with_length:
        return np.unique(w)
    n = len(w)
    total = sum(size[j : j + n] for j in range(k))
    w, at = np.unique(w, return_index=True)
    return w, total[at]


def digest(h: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes, whatever their order."""
    return int(mix(np.array([mix(h ^ _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + _U(len(h))], np.uint64)).view(np.int64)[0])
