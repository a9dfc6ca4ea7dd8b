"""MD5 of many short texts at once, by numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of a text that one block of MD5 has room for.
ROOM = 55
_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]).repeat(4, 0).ravel()
_TERMS = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_WORDS = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *((7 * k) % 16 for k in range(16))]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes with MD5's closing byte, and their lengths."""
    sizes = np.array([len(t) for t in texts])
    rows = np.zeros((len(texts), sizes.max(initial=0) + 1), np.uint8)
    for row, t in zip(rows, texts, strict=True):
        row[: len(t)] = np.frombuffer(t, np.uint8)
        row[len(t)] = 0x80
    return rows, sizes


def first_digits(heads: list[bytes], tails: list[bytes], tail_rows: np.ndarray, tail_sizes: np.ndarray) -> np.ndarray:
    """The number of the first 15 hex digits of the MD5 of each head + tail, tails in turn for each head. ``tail_rows``, ``tail_sizes``: padded(tails)."""
    n, width = len(tails), tail_rows.shape[1]
    if max(map(len, heads)) + width - 1 > ROOM:
        return np.array([int(hashlib.md5(h + t).hexdigest()[:15], 16) for h in heads for t in tails], np.uint64)
    rows = np.zeros((len(heads), n, 64), np.uint8)
    sizes = np.empty((len(heads), n), np.uint32)
    for k, h in enumerate(heads):
        rows[k, :, : len(h)] = np.frombuffer(h, np.uint8)
        rows[k, :, len(h) : len(h) + width] = tail_rows
        sizes[k] = (tail_sizes + len(h)) * 8
    words = list(np.ascontiguousarray(rows.reshape(-1, 64).view("<u4").T))
    words[14] = sizes.ravel()
    used = [bool(w.any()) for w in words]
    a, b, c, d = (np.full(len(heads) * n, s, np.uint32) for s in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _TERMS[k]
        if used[_WORDS[k]]:
            a += words[_WORDS[k]]
        np.right_shift(a, np.uint32(32 - _SHIFTS[k]), out=g)
        a <<= np.uint32(_SHIFTS[k])
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    high, low = ((x + s).byteswap().astype(np.uint64) for x, s in ((a, _START[0]), (b, _START[1])))
    return (high << np.uint64(28)) | (low >> np.uint64(4))
