"""A read-only hash table of 64-bit keys for numpy arrays of lookups."""

from __future__ import annotations

import numpy as np


class HashTable:
    """Places of keys, -1 for others. Levels of direct addressing: keys that clash go a level down."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys``: distinct, uint64."""
        self.levels: list[tuple[np.ndarray, np.ndarray, np.uint64]] = []
        left, shift = np.arange(len(keys)), 0
        while len(left):
            bits = max(4, int(2 * len(left) - 1).bit_length())
            down = np.uint64(64 - bits)
            at = self._slot(keys[left], shift, down)
            place = np.full(1 << bits, -1, np.int32)
            place[at] = left  # the last of those that clash stays
            won = place[at] == left
            held = np.zeros(1 << bits, np.uint64)
            held[at[won]] = keys[left[won]]
            self.levels.append((held, place, down))
            left, shift = left[~won], shift + 1

    @staticmethod
    def _slot(keys: np.ndarray, level: int, down: np.uint64) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> down).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        todo = None
        for level, (held, place, down) in enumerate(self.levels):
            asked = keys if todo is None else keys[todo]
            at = self._slot(asked, level, down)
            found = place[at]
            good = (held[at] == asked) & (found >= 0)
            if todo is None:
                out[good] = found[good]
                todo = np.flatnonzero(~good & (found >= 0))  # an empty slot ends the search
            else:
                out[todo[good]] = found[good]
                todo = todo[~good & (found >= 0)]
            if not len(todo):
                break
        return out
