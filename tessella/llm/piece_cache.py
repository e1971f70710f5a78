"""Token ids of text pieces, remembered by a Python worker across batches.

Pieces are keyed by a 64-bit hash of their bytes and held in flat arrays. Once
LIMIT pieces are held, further new ones are encoded again in each batch that has
them, so memory is bounded and results do not change.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LIMIT = 1_500_000


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceCache:
    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = LIMIT):
        """encode: pieces to (ids of each, flat ids)."""
        self.encode, self.limit = encode, limit
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.levels = [none, none]  # hash, start, size: a large level and a recent one
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _put(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at

    def ids(self, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces data[offsets[i]:offsets[i + 1]]: how many ids each has, and all ids in order."""
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        start, size, new = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32), np.ones(len(keys), bool)
        for held, at, n in self.levels:
            if len(held):
                i = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[i] == keys
                start[hit], size[hit], new[hit] = at[i[hit]], n[i[hit]], False
        before = self.used
        if new.any():
            raw, at = data.tobytes(), offsets.tolist()
            sizes, flat = self.encode([raw[at[i] : at[i + 1]] for i in first[new].tolist()])
            base = self._put(flat)
            start[new] = base + np.cumsum(sizes) - sizes
            size[new] = sizes
        out = self.pool[ragged(start[back], size[back])]
        if new.any():
            if sum(len(x[0]) for x in self.levels) + new.sum() <= self.limit:
                self.levels[1] = self._merge(self.levels[1], (keys[new], start[new], size[new]))
                if len(self.levels[1][0]) > len(self.levels[0][0]) // 4:
                    self.levels = [self._merge(*self.levels), tuple(x[:0] for x in self.levels[1])]
            else:
                self.used = before
        return size[back], out

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)
