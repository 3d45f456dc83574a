"""Search for many byte strings at once after Wu and Manber, over many texts side by side.

All patterns of one table have the same length. A table over blocks of bytes says how far the window may be moved: a
block that ends no pattern lets it skip, a block that stands in none skips the most. Where the shift is 0 the block's
hash picks a bucket of patterns with that suffix, whose first bytes and then whole strings are compared with the text.
The windows of thousands of texts move in step, as arrays.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text that one window scans; free slots of the shift table for each block of a pattern.
LANE, SPARE = 2048, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as numbers; ``data`` is padded by 8 bytes at least."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))


class Patterns:
    """The tables for a list of byte strings of ``length`` bytes; equal strings are kept apart by their number."""

    def __init__(self, strings: list[bytes], length: int = 20):
        self.length, self.block = length, (length + 1) // 2
        n, moves = len(strings), self.length - self.block + 1
        self.bits = min(26, max(16, (SPARE * n * moves).bit_length()))
        data = np.frombuffer(b"".join(strings) + bytes(16), np.uint8)
        at = np.arange(n) * length
        eight = _words(data)
        self.shift = np.full(1 << self.bits, moves, np.uint8)
        for j in range(moves):
            h = self._hash(eight, at + j)
            self.shift[h >> np.uint64(64 - self.bits)] = moves - 1 - j
        order = np.argsort(h, kind="stable")
        self.suffix, self.number = h[order], order
        self.parts = [(o, self._part(eight, at + o)[order]) for o in ([*range(0, length - 8, 8), length - 8] if length > 8 else [0])]

    def _hash(self, eight: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for the block that begins at each position."""
        if self.block > 8:
            h = eight[at] * _A ^ eight[at + (self.block - 8)] * _B
        else:
            h = (eight[at] & np.uint64((1 << 8 * self.block) - 1)) * _A
        return h ^ (h >> np.uint64(29))

    def _part(self, eight: np.ndarray, at: np.ndarray) -> np.ndarray:
        return eight[at] if self.length >= 8 else eight[at] & np.uint64((1 << 8 * self.length) - 1)

    def search(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in texts at ``starts`` of ``data`` (padded by 16 bytes): positions and pattern numbers."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        last = lengths - self.length + 1  # windows of a text
        lanes = np.maximum(0, -(-last // LANE))
        text = np.repeat(np.arange(len(starts)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = starts[text] + part * LANE
        end = starts[text] + np.minimum(last[text], (part + 1) * LANE)
        if not len(self.suffix) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        eight = _words(data)
        while len(at):
            h = self._hash(eight, at + (self.length - self.block))
            step = self.shift[h >> np.uint64(64 - self.bits)]
            stop = np.flatnonzero(step == 0)
            if len(stop):
                here, key = at[stop], h[stop]
                low = np.searchsorted(self.suffix, key, "left")
                n = np.searchsorted(self.suffix, key, "right") - low
                if n.any():
                    pos = np.repeat(here, n)
                    slot = np.repeat(low, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
                    same = np.ones(len(pos), bool)
                    for o, words in self.parts:
                        same &= self._part(eight, pos + o) == words[slot]
                    if same.any():
                        found.append((pos[same], self.number[slot[same]]))
            at = at + np.maximum(step, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p for p, _ in found]), np.concatenate([i for _, i in found])
