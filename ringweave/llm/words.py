"""Words of many texts at once: positions and hashes as numpy arrays over one buffer of UTF-8 bytes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
LONG = 256
_ONES = U((1 << 64) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs only give equal outputs."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    return mix(mix(left) * U(0x9E3779B97F4A7C15) + right)


def windows(names: np.ndarray, n: int) -> np.ndarray:
    """A name for each n consecutive names, by the first: pairs of pairs, as far as n goes. The steps aren't linear, so no arrangement of words makes them cancel."""
    have, whole, out, done = 1, names, None, 0
    while True:
        if n & have:
            out = whole if out is None else joined(out[: max(0, len(out) - have)], whole[done : done + max(0, len(out) - have)])
            done += have
        if have * 2 > n:
            return out
        whole, have = joined(whole[: max(0, len(whole) - have)], whole[have:]), have * 2


class Words:
    """first, past: byte positions of the words; of: where each text's words begin (and the number of words); hash: a hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] |= solid[edges]
        end[edges - 1] |= solid[edges - 1]
        self.first, self.past = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.of = np.searchsorted(self.first, offsets)
        self._data = data
        self.hash = self.hashed(0)

    def hashed(self, seed: int) -> np.ndarray:
        """A hash of each word: its bytes are mixed in eight at a time, and words over LONG bytes go to a library."""
        if not len(self.first):
            return np.zeros(0, U)
        padded = np.concatenate([self._data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self._data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
        size = self.past - self.first
        out = mix(size.astype(U) + U(seed) * U(0xD1342543DE82EF95))
        some, k = np.arange(len(size)), 0
        long = size > LONG
        if long.any():
            some = np.flatnonzero(~long)
            out[long] = [xxh3_64_intdigest(self._data[a:b].tobytes(), seed) for a, b in zip(self.first[long], self.past[long])]
        while len(some):
            rest = np.minimum(size[some] - k, 8)
            part = eight[self.first[some] + k] & (_ONES >> (U(64) - U(8) * rest.astype(U)))
            out[some] = mix(out[some] * U(0x9E3779B97F4A7C15) + part)
            k += 8
            some = some[size[some] > k]
        return out

    def windows(self, n: int) -> np.ndarray:
        """A hash of each n consecutive words, by first word; windows over the end of a text are among them."""
        return windows(self.hash, n)

    def texts(self, seed: int = 0) -> np.ndarray:
        """A hash of each text's whole word sequence."""
        first, past = self.of[:-1], self.of[1:]
        place = np.arange(len(self.hash), dtype=U) - np.repeat(first, past - first).astype(U)
        words = self.hashed(seed) if seed else self.hash
        summed = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words + mix(place + U(seed + 1))), out=summed[1:])
        return mix((summed[past] - summed[first]) ^ (past - first).astype(U))
