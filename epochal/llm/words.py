"""The words of many texts, with their places and hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .blocks import raw
from .common import Hashes

_BYTES = Hashes(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Places and hashes of all words of a text column."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False):
        self.data, self.off = raw(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        solid = ~_SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        before = np.r_[False, solid[:-1]] if n else solid
        self.start = np.flatnonzero(solid & (~before | first[:n]))
        after = np.r_[solid[1:], False] if n else solid
        self.end = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.row = (np.searchsorted(self.off, self.start, "right") - 1).astype(np.int32)
        self.first = np.searchsorted(self.start, self.off)  # first word of each row, and the number of words
        self.hash = _BYTES.strings(self.data, self.start, self.end)

    def windows(self, length: int, hashes: Hashes) -> np.ndarray:
        """Hash of each window by its first word."""
        return hashes.windows(self.hash, length)

    def inside(self, length: int) -> np.ndarray:
        """Whether the window of ``length`` words from each word, of those that a window can start with, lies in one text."""
        m = max(0, len(self.start) - length + 1)
        return self.row[:m] == self.row[length - 1 : length - 1 + m]
