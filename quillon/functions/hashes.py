"""md5 of many short texts at once, for draws that go by md5 order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _one_block(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """(4, n) uint32: digests of n messages of one block, whose words are arrays or the same for all."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        w = words[_WORD[i]]
        if isinstance(w, int):
            f += np.uint32((_ADD[i] + w) & 0xFFFFFFFF)
        else:
            f += w
            f += np.uint32(_ADD[i])
        a, d, c = d, c, b
        up = f << np.uint32(_TURN[i])
        f >>= np.uint32(32 - _TURN[i])
        f |= up
        f += b
        b = f
    return np.stack([x + np.uint32(v) for x, v in zip((a, b, c, d), _START, strict=True)])


class Md5Order:
    """Names in the order of md5(prefix + name), for one prefix after another."""

    def __init__(self, names: pa.Array):
        names = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).cast(pa.large_binary())
        self.names, self.count = names, len(names)
        long = pc.binary_length(names).to_numpy(zero_copy_only=False)
        self.by_length = [(int(n), np.flatnonzero(long == n)) for n in np.unique(long)]
        self.words: tuple[int, list] = (-1, [])

    def _laid_out(self, at: int) -> list:
        """For each length of names: (length, rows, words of the messages whose names begin at this byte)."""
        if self.words[0] != at:
            found = []
            for n, rows in self.by_length:
                if at + n <= 55:
                    text = np.zeros((len(rows), 4 * ((at + n) // 4 + 1)), np.uint8)
                    text[:, at : at + n] = np.frombuffer(b"".join(self.names.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), n)
                    text[:, at + n] = 0x80
                    found.append((n, rows, np.ascontiguousarray(text.view("<u4").T)))
                else:
                    found.append((n, rows, None))
            self.words = at, found
        return self.words[1]

    def _digests(self, prefix: bytes, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, (4, n) digests as big-endian words) of all names."""
        head = np.frombuffer(prefix + b"\0" * (-len(prefix) % 4), "<u4")
        for n, rows, words in self._laid_out(len(prefix)):
            if words is None:
                digests = b"".join(hashlib.md5(prefix + x).digest() for x in self.names.take(pa.array(rows)).to_pylist())
                yield rows, np.frombuffer(digests, ">u4").reshape(-1, 4).T
                continue
            for i in range(0, len(rows), step):
                part = words[:, i : i + step]
                block = [part[j] | head[j] if j < len(head) else part[j] for j in range(len(part))]
                block += [0] * (16 - len(block))
                block[14] = 8 * (len(prefix) + n)
                yield rows[i : i + step], _one_block(block, part.shape[1]).astype("<u4").view(">u4")

    def first_words(self, prefix: bytes, step: int = 8192) -> np.ndarray:
        """The first eight hexadecimal digits of each md5(prefix + name), as numbers."""
        out = np.empty(self.count, np.int64)
        for rows, digests in self._digests(prefix, step):
            out[rows] = digests[0]
        return out

    def order(self, prefix: bytes, step: int = 8192) -> np.ndarray:
        """Places of the names in order; equal hashes keep the order of the names."""
        high, low = np.empty(self.count, np.uint64), np.empty(self.count, np.uint64)
        for rows, digests in self._digests(prefix, step):
            one = digests.astype(np.uint64)
            high[rows], low[rows] = one[0] << np.uint64(32) | one[1], one[2] << np.uint64(32) | one[3]
        found = np.argsort(high)
        close = high[found]
        return np.lexsort((low, high)) if (close[1:] == close[:-1]).any() else found
