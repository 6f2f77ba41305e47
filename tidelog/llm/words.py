"""Words and word shingles of whole texts, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text with A-Z lowered; this is
the regular expression ``[^\\x20\\x09-\\x0D]+``.  Hashes are the same in every process and on every machine.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits with full avalanche (the SplitMix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(n + n // 4 + 1024, base, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def byte_prefix(b: np.ndarray) -> np.ndarray:
    """Prefix sums H with H[j]-H[i] = base**i times the polynomial hash of bytes i..j-1."""
    up, _ = _power(len(b) + 1)
    h = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], dtype=_U, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes between ``start`` and ``end`` from :func:`byte_prefix`."""
    _, down = _power(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, offsets of each text's first word and the end)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    raw = b"\n".join([t or b"" for t in texts]) + b"\n"
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    gap = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(b) and not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(sizes + 1)
    offsets = np.concatenate(([0], np.searchsorted(start, ends)))
    return span_hash(byte_prefix(b), start, end), offsets


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; runs that cross texts are the caller's to leave out."""
    out = np.full(max(0, len(w) - n + 1), n, _U)
    for i in range(n):
        out = mix(out * _U(0x9FB21C651E98DF25) + w[i : len(w) - n + 1 + i])
    return out


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each text; a shorter text is one shingle, no words: none."""
    w, at = word_hashes(texts)
    g = ngram_hashes(w, k)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= k:
            out.append(np.unique(g[s : e - k + 1]))
        elif e > s:
            out.append(ngram_hashes(w[s:e], e - s))
        else:
            out.append(np.zeros(0, _U))
    return out


def pieces(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``most`` at the most (or hold one item)."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += n
    if len(sizes) > at:
        out.append((at, len(sizes)))
    return out
