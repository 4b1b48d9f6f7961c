"""Token ids of the parts of texts, each distinct part encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class PartCache:
    """learn(parts) gives (ids of all parts end to end, number of each part's). At most ``most`` parts are kept; beyond,
    all are forgotten."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = np.zeros(1024, np.int32)
        self.begin = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = self.count = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _add(self, parts: list[str]) -> int:
        """Learns parts that aren't known. Returns the row of the first; the others follow."""
        ids, counts = self.learn(parts)
        first, n, total = self.count, len(parts), len(ids)
        self.size, self.begin, self.ids = self._room(self.size, first + n), self._room(self.begin, first + n), self._room(self.ids, self.used + total)
        self.size[first : first + n] = counts
        self.begin[first : first + n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + total] = ids
        self.used, self.count = self.used + total, first + n
        return first

    def rows(self, parts: list[str]) -> np.ndarray:
        """The row of each part."""
        if self.count > self.most:
            self.forget()
        found = list(map(self.known.get, parts))
        if None in found:
            fresh = list(dict.fromkeys(p for p, i in zip(parts, found) if i is None))
            first = self._add(fresh)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
            found = list(map(self.known.get, parts))
        return np.array(found, np.int64)

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows end to end, number of ids before each row and after the last)."""
        n = self.size[rows].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        flat = np.arange(before[-1]) + np.repeat(self.begin[rows] - before[:-1], n)
        return self.ids[flat], before


#: Bytes that a key of the table holds; longer parts are looked up as strings.
SHORT = 15
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class ByteCache(PartCache):
    """As PartCache, for parts that are given as places in an array of UTF-8 bytes. Parts of up to SHORT bytes stand, bytes
    and length, in a table with open addressing, so that no part that is known becomes a Python object."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, bits: int | None = None):
        self.bits = bits or max(10, int(2 * most).bit_length())
        super().__init__(learn, most)

    def forget(self) -> None:
        super().forget()
        self.low = np.zeros(1 << self.bits, np.uint64)
        self.high = np.zeros(1 << self.bits, np.uint64)  # the length is in the top byte, so 0 is an empty place
        self.row = np.zeros(1 << self.bits, np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it isn't known."""
        found = np.full(len(low), -1, np.int64)
        place, left = self._home(low, high), np.arange(len(low))
        while len(left):
            there = self.high[place]
            same = (there == high[left]) & (self.low[place] == low[left])
            found[left[same]] = self.row[place[same]]
            go = ~same & (there != 0)
            left, place = left[go], (place[go] + 1) & ((1 << self.bits) - 1)
        return found

    def _insert(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> None:
        """Puts different keys in."""
        place, left = self._home(low, high), np.arange(len(low))
        while len(left):
            free = self.high[place] == 0
            at, key = place[free], left[free]
            self.low[at], self.high[at], self.row[at] = low[key], high[key], rows[key]
            # of keys that wanted the same place one has it
            lost = ~((self.high[place] == high[left]) & (self.low[place] == low[left]))
            left, place = left[lost], (place[lost] + 1) & ((1 << self.bits) - 1)

    def rows_at(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each part data[begin:end]."""
        if self.count > self.most:
            self.forget()
        n = end - begin
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        word = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))  # eight bytes from every place on
        short = np.minimum(n, SHORT)
        low = word[begin] & MASKS[np.minimum(short, 8)]
        high = word[np.minimum(begin + 8, len(data))] & MASKS[np.maximum(short - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        out = np.empty(len(n), np.int64)
        long = np.flatnonzero(n > SHORT)
        if len(long):
            out[long] = self.rows([padded[a:b].tobytes().decode() for a, b in zip(begin[long], end[long])])
            is_short = n <= SHORT
            out[is_short] = self._known(low[is_short], high[is_short], padded, begin[is_short], n[is_short])
        else:
            out[:] = self._known(low, high, padded, begin, n)
        return out

    def _known(self, low: np.ndarray, high: np.ndarray, data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[first]
            rows = self._add([data[a : a + k].tobytes().decode() for a, k in zip(begin[one].tolist(), n[one].tolist())]) + np.arange(len(one))
            self._insert(low[one], high[one], rows)
            found[order] = rows[np.cumsum(first) - 1]
        return found
