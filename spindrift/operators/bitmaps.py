"""Compressed sets of 16-bit numbers: a sorted array while small, a plain bitmap beyond, whichever takes less room."""

from __future__ import annotations

import numpy as np

#: Keys in one range of a bitmap; above LIMIT members a bitmap (8 KiB) is smaller than an array of 16-bit numbers.
RANGE, LIMIT = 1 << 16, 4096


class Bitmap:
    """An immutable set of numbers in [0, RANGE). ``data`` is uint16 and sorted, or uint8 with a bit a number."""

    __slots__ = ("data",)

    def __init__(self, data: np.ndarray):
        self.data = data

    @classmethod
    def of(cls, members: np.ndarray) -> Bitmap:
        low = np.unique(members).astype(np.uint16)
        return cls(low if len(low) <= LIMIT else cls._bits(low))

    @staticmethod
    def _bits(low: np.ndarray) -> np.ndarray:
        flags = np.zeros(RANGE, np.uint8)
        flags[low] = 1
        return np.packbits(flags)

    @property
    def dense(self) -> bool:
        return self.data.dtype == np.uint8

    def bits(self) -> np.ndarray:
        return self.data if self.dense else self._bits(self.data)

    def members(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.data)).astype(np.uint16) if self.dense else self.data

    def __or__(self, other: Bitmap) -> Bitmap:
        if not (self.dense or other.dense):
            return Bitmap.of(np.union1d(self.data, other.data))
        return Bitmap(self.bits() | other.bits())

    def and_not(self, other: Bitmap) -> Bitmap:
        if not self.dense:
            return Bitmap(self.data[~other.holds(self.data)])
        left = self.bits() & ~other.bits()
        return Bitmap(left) if int(np.unpackbits(left).sum()) > LIMIT else Bitmap.of(Bitmap(left).members())

    def holds(self, low: np.ndarray) -> np.ndarray:
        if self.dense:
            return (self.data[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1
        return np.isin(low, self.data, assume_unique=True)


EMPTY = Bitmap(np.zeros(0, np.uint16))
