"""Draws named by md5 as array operations: md5 of many short texts at once."""

from __future__ import annotations

import math

import numpy as np

# The constants, shifts and start of MD5 (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: (factor, offset) of the word that a step of each round takes.
_WORDS = ((1, 0), (5, 1), (3, 5), (7, 0))


def md5_heads(words: list, size: int) -> np.ndarray:
    """First 32 bits, big-endian, of md5 of `size` messages of one block; words: its 16 words, each an int or an array."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        kind = i >> 4
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:  # b ^ c ^ d
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        factor, offset = _WORDS[kind]
        word = words[(factor * i + offset) & 15]
        if isinstance(word, np.ndarray):
            f += np.uint32(_SINES[i])
            f += word
        else:
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        shift = _SHIFTS[kind][i & 3]
        np.left_shift(f, shift, out=t)
        np.right_shift(f, 32 - shift, out=f)
        np.bitwise_or(f, t, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_START[0])
    return a.byteswap()


def draws(head: str, first: int, stop: int, n: int) -> np.ndarray:
    """First 32 bits of md5 of head followed by k, modulo n, for k from first to before stop; head and k have at most 55 bytes."""
    out, lead = np.empty(stop - first, np.int64), head.encode()
    k = first
    while k < stop:
        digits = len(str(k))
        top, size = min(stop, 10**digits), len(lead) + digits
        rest, columns = np.arange(k, top), []
        for _ in range(digits):
            rest, digit = np.divmod(rest, 10)
            columns.append((digit + 48).astype(np.uint32))
        message = [*lead, *reversed(columns), 0x80]
        words = [0] * 14 + [8 * size, 0]
        for place, byte in enumerate(message):
            words[place // 4] = words[place // 4] | byte << (8 * (place % 4))
        words = [w.astype(np.uint32) if isinstance(w, np.ndarray) else w for w in words]
        out[k - first : top - first] = md5_heads(words, top - k).astype(np.int64) % n
        k = top
    return out
