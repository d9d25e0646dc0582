"""Vectorised word splitting and 64-bit word hashing over UTF-8 bytes.

A run of rows is one byte buffer with row offsets.  A translation table folds
A-Z to lower case and maps every separator byte to a blank, so splitting is a
comparison and hashing a few 8-byte loads per word; nothing runs per character
in Python.  Multi-byte code points consist of bytes >= 0x80, which no table here
treats as separators, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import hashlib

import numpy as np

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: words are runs of anything but blank and 0x09-0x0D
WHITESPACE_WORDS = bytes(32 if c == 32 or 9 <= c <= 13 else _FOLD[c] for c in range(256))
#: words are runs of digits, letters and non-ASCII
ALNUM_WORDS = bytes(_FOLD[c] if 48 <= _FOLD[c] <= 57 or 97 <= _FOLD[c] <= 122 or c >= 128 else 32
                    for c in range(256))

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LEN = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(32)
#: words beyond this many bytes are digested whole instead of 8 bytes at a time
_LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


class Words:
    """Words of a run of rows: byte spans, first word of each row, hashes."""

    def __init__(self, raw: bytes, off: np.ndarray, table: bytes = WHITESPACE_WORDS):
        self.n = n = len(raw)
        self.folded = raw.translate(table)
        self.buf = buf = np.frombuffer(self.folded + bytes(16), np.uint8)
        is_word = buf[:n] != 32
        first = np.zeros(n + 1, bool)
        first[off] = True
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1] | first[1:n]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:] | first[1:n]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.row_first = np.searchsorted(self.starts, off)

    def load8(self, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``min(length, 8)`` bytes from each position as one integer."""
        view = np.ndarray((self.n + 8,), "<u8", buffer=self.buf, strides=(1,))
        return view[pos] & _MASK[np.minimum(length, 8)]

    def hashes(self) -> np.ndarray:
        starts, length = self.starts, self.ends - self.starts
        h = mix(self.load8(starts, length) + length.astype(np.uint64) * _LEN)
        left = np.flatnonzero(length > 8)
        pos = 8
        while left.size:
            if pos >= _LONG:
                for i in left:
                    d = hashlib.blake2b(self.folded[starts[i]:self.ends[i]], digest_size=8).digest()
                    h[i] ^= np.frombuffer(d, "<u8")[0]
                break
            h[left] = mix(h[left] ^ (self.load8(starts[left] + pos, length[left] - pos) * _M2 + np.uint64(pos)))
            pos += 8
            left = left[length[left] > pos]
        return h
