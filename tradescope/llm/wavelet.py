"""A wavelet matrix over token ids: bit planes with rank directories in one byte string each."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Bits between two entries of a plane's rank directory.
BLOCK = 512


@dataclass
class WaveletMatrix:
    """Token access, counting and occurrence lookup over ``n`` ids below 2**len(planes).

    ``planes[k]`` holds bit ``len(planes) - 1 - k`` of the ids in the order of level k:
    at every level the ids with a zero bit move before those with a one, otherwise in order.
    ``zeros[k]`` is how many moved to the front.
    """

    n: int
    planes: list[bytes]
    zeros: list[int]
    _directories: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def built(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros = [], []
        current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            ones = (current & current.dtype.type(1 << level)) != 0
            planes.append(np.packbits(ones).tobytes())
            zeros.append(int(len(ones) - ones.sum()))
            current = np.concatenate([np.compress(~ones, current), np.compress(ones, current)])
        return cls(len(ids), planes, zeros)

    def _ones(self, level: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n).view(bool)

    def rank(self, level: int, place: int) -> int:
        """Ones among the first ``place`` bits of a plane: one directory entry and one block."""
        octets = np.frombuffer(self.planes[level], np.uint8)
        if level not in self._directories:
            padded = np.zeros(-(-len(octets) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(octets)] = octets
            sums = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            self._directories[level] = np.concatenate([[0], np.cumsum(sums)])
        block, rest = divmod(place, BLOCK)
        first = block * BLOCK // 8
        whole, bits = divmod(rest, 8)
        ones = int(np.bitwise_count(octets[first : first + whole]).sum())
        if bits:
            ones += (int(octets[first + whole]) >> (8 - bits)).bit_count()
        return int(self._directories[level][block]) + ones

    def select(self, level: int, bit: int, count: int) -> int:
        """Place of the ``count``-th (from 0) bit of that value in a plane, by bisection of rank."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self.rank(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > count:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, place: int) -> int:
        """The id at a place, following one bit per plane."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self.planes[level][place // 8] >> (7 - place % 8) & 1
            ones = self.rank(level, place)
            place = zeros + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token in [begin, end) lie behind the last level."""
        levels = len(self.planes)
        if token >> levels:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            before, upto = self.rank(level, begin), self.rank(level, end)
            if token >> (levels - 1 - level) & 1:
                begin, end = zeros + before, zeros + upto
            else:
                begin, end = begin - before, end - upto
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [begin, end)."""
        low, high = self._range(token, begin, self.n if end is None else end)
        return high - low

    def find(self, token: int, number: int) -> int:
        """Place of the ``number``-th (from 0) occurrence of a token; -1 if there is none."""
        low, high = self._range(token, 0, self.n)
        if number >= high - low:
            return -1
        place, levels = low + number, len(self.planes)
        for level in range(levels - 1, -1, -1):
            bit = token >> (levels - 1 - level) & 1
            place = self.select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def ids(self) -> np.ndarray:
        """All ids in order: the levels are undone from the last to the first."""
        levels = len(self.planes)
        # Behind the last level the ids are sorted by their reversed bits; only places count.
        width = np.uint16 if levels <= 16 else np.uint32
        value = np.zeros(self.n, width)
        for level in range(levels - 1, -1, -1):
            ones = self._ones(level)
            before = np.empty(self.n, width)
            before[np.flatnonzero(~ones)] = value[: self.zeros[level]]
            before[np.flatnonzero(ones)] = value[self.zeros[level] :] | width(1 << (levels - 1 - level))
            value = before
        return value
